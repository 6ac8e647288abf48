"""Truth tables of the Column functions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsieve.functions import convert, derive, predicates, text
from quillsieve.functions.convert import Level


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").repartition(1).sortWithinPartitions("i")
    return [r[0] for r in df.select(f(F.col("x")).alias("y")).collect()]


CASES = {
    "lowercase": (text.lowercase, {"WeiRd CaPs": "weird caps", None: None}),
    "squish": (text.squish, {" - - - --- --": "-", "A --B": "A-B", "  a \t  b ": "a b", "": "", None: None}),
    "collapse": (text.collapse_repeats, {"0..\\//\\..01": "0./.01", "a/b": "a/b", None: None}),
    "unicode": (text.map_unicode, {"98.6°": "98.6degrees", "a±b": "a+/-b", "‹x›": "<x>", "“q”": '"q"', "½": "½", "a‎b﻿": "ab", "x y": "x y", "–": "-"}),
    "excel": (text.null_excel_failures, {"#div/0!": None, "=#VALUE!": None, "puppies#error!": "puppies#error!", "ok": "ok"}),
    "numeric strip": (lambda c: text.strip_nonword(c, True), {".2m": "0.2", ".5 %": "0.5", "-4.0": "na", "> 20": "greater than 20"}),
    "strip": (text.strip_nonword, {";.something+": "something", "[thing1": "thing1", "thing2]": "thing2]", ".1": "1", "<5": "less than 5", "- 3 below": "na", "f(x)": "f(x)", "é!": "é"}),
    "missing": (text.normalize_missing, {"not apppplplicabe": None, "n/a": None, "": None, "none": "none", " ": " ", "unvailable": "unvailable", "unavailable": None, "unkown": None, "nil": None}),
    "values": (lambda c: text.null_values(c, ["x", "y"]), {"x": None, "z": "z", None: None}),
    "numeric": (convert.parse_numeric, {"1cm": 1.0, "-4.0mmhg": -4.0, "100/80": None, "1.5 m": 1.5, "169 / 100": None, "100.2and200": 100.2, "1.": 1.0, "": None, None: None, "x1": None, "12 3": None}),
    "pressure": (convert.parse_pressure, {"180/90": "180/90", "100    /    40": "100/40", "120-80 mmhg": "120/80", "10010": None, "200": None, None: None, "1,2": "1/2"}),
    "undelimited": (lambda c: convert.parse_pressure(c, True), {"10010": "100/10", "1280": "12/80", "120100": "120/100", "1234567": None, "120/80": "120/80"}),
    "year": (convert.parse_year, {"12/8/08": 2008.0, "april 2012": 2012.0, "march,2020": 2020.0, "march2020": 2020.0, "2001": 2001.0, "1999-01-02": 1999.0, "04": None, "hello_world": None, "1/1/22": 1922.0, "1/1/21": 2021.0, "1/1/1700": None, "10-2006": 2006.0, None: None}),
    "first degree": (derive.first_degree, {"mother": "yes", "uncle; sister ": "yes", "aunt": "no", "children": "yes", None: None, "grandmother": "no"}),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    f, table = CASES[name]
    assert dict(zip(table, apply(spark, f, list(table)), strict=True)) == table


def test_levels(spark):
    levels = (Level("pineapple", ("Pineapple", "pointy yellow thing")), Level("apple", ("a.*e",)))
    assert apply(spark, lambda c: convert.parse_levels(c, levels), ["Pineapple", "pointy yellow thing", "apple", "axe", "pear", None]) == ["pineapple", "pineapple", "apple", "apple", None, None]
    # an ungrouped alternative frees its sides from the anchors; only the first match is replaced
    leaky = (Level("L", ("a|b",)),)
    assert apply(spark, lambda c: convert.map_levels(c, leaky), ["axx", "xxb", "xax", "ab"]) == ["Lxx", "xxL", "xax", "Lb"]
    # a level's output may be taken by a later level
    assert apply(spark, lambda c: convert.map_levels(c, (Level("b", ("a",)), Level("c", ("b",)))), ["a"]) == ["c"]
    assert apply(spark, lambda c: convert.map_levels(c, (Level("$1\\", ("a",)),)), ["a"]) == ["$1\\"]
    assert apply(spark, lambda c: convert.level_rank(c, (Level("lo"), Level("hi"))), ["hi", "lo", "other", None]) == [2, 1, None, None]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB -./\\\t °é", max_size=12), min_size=1, max_size=6))
def test_cleaning_is_idempotent(spark, values):
    for f in (text.lowercase, text.squish, text.collapse_repeats):
        once = apply(spark, f, values)
        assert apply(spark, f, once) == once


T, N = True, None


def test_predicates(spark):
    rows = [("yes", "yes", 1.0, 2.0), (N, "no", 2.0, 1.0), ("no", N, 1.0, 1.0), ("yes", "no", N, 1.0), ("na", "no", 1.0, N)]
    df = spark.createDataFrame(rows, "d string, i string, x double, y double").coalesce(1)
    d, i, x, y = (F.col(c) for c in "dixy")
    want = {
        "yes": (predicates.depends_on_yes(d, i), [T, T, False, False, False]),
        "yes aliases": (predicates.depends_on_yes(d, i, ["yes"], ["no"], ["na"]), [T, T, False, T, T]),
        "not na": (predicates.depends_on_not_na(d, i), [T, T, False, T, T]),
        "not na aliases": (predicates.depends_on_not_na(d, i, ["no"]), [T, T, False, False, False]),
        "less": (predicates.less_than(x, y), [T, False, False, T, T]),
        "greater": (predicates.greater_than(x, y), [False, T, T, T, T]),
        "strictly": (predicates.greater_than(x, y, False), [False, T, False, T, T]),
        "duplicate": (predicates.duplicate_of(x, y), [False, False, T, T, T]),
        "bmi": (predicates.computed_bmi(x, y * 4, F.lit(2.0), 0.5), [False, False, T, T, T]),
        "bmi of no height": (predicates.computed_bmi(x, y, F.lit(0.0), 9), [False, False, False, T, T]),
        "year": (predicates.year_fits_age(x + 2000, y, 2003, 1.0), [T, T, False, T, T]),
    }
    got = df.select(*[c.alias(k) for k, (c, _) in want.items()]).collect()
    for k, (_, w) in want.items():
        assert [r[k] for r in got] == w, k


def test_normal_quantile(spark):
    from statistics import NormalDist

    p = [1e-300, 1e-14, 1e-5, 0.01, 0.074, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.99999, 0.0, 1.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").coalesce(1).select(derive.normal_quantile(F.col("p"))).collect()]
    for x, y in zip(p, got, strict=True):
        if x in (0.0, 1.0, None):
            assert y is None
        elif x > 1e-200:
            assert y == pytest.approx(NormalDist().inv_cdf(x), abs=1e-9)
    assert got[0] == pytest.approx(-37.0471, abs=1e-3)


def test_osa(spark):
    assert [derive.similarity(a, b) for a, b in (("belorussian", "belarusian"), ("ab", "ba"), ("ca", "abc"), ("", ""))] == [pytest.approx(0.8181818), 0.5, pytest.approx(0.0), 1.0]
