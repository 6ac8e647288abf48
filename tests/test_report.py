"""Comparison sections, grouped histograms and exclusion counts of the report."""

import pytest
from pyspark.sql import functions as F

from quillsieve.operators import profile, rows
from quillsieve.plans import config, pipeline
from quillsieve.plans.config import ConfigError
from quillsieve.sources import report

DATASET = """
tag: KI
globals: {min_age_for_inclusion: 20, max_invalid_datatypes_per_subject: 9}
variables:
  KI1: {name: kite, type: string, canonical_name: kite, subject_id: true}
  KI2: {name: years, type: numeric, canonical_name: age, subject_age: true, multimodal: KI7, linked_date: {reported_year: KI3, reference_year: 2020}}
  KI3: {name: born, type: date, canonical_name: year}
  KI4: {name: index, type: numeric, canonical_name: index, computed_bmi: {weight: KI5, height: KI6}}
  KI5: {name: mass, type: numeric, canonical_name: mass}
  KI6: {name: span, type: numeric, canonical_name: span}
  KI7: {name: field, type: categorical, canonical_name: field, levels: {l1: {name: north}, l2: {name: south}}}
  KI8: {name: upper, type: numeric, canonical_name: upper, computed_bp_ratio: {diastolic: KI9}}
  KI9: {name: lower, type: numeric, canonical_name: lower}
"""
TABLE = [("a", "30", "1990", "20", "80", "2", "north", "120", "80"), ("b", "41", "1979", "25", "100", "2", "south", "130", None), ("c", "19", "2001", "21", "81", "2", "south", "110", "70"), (None, "52", "1968", "22", "88", "2", "north", "125", "85"), ("d", None, "1968", "22", "88", "2", "north", "125", "85"), ("e", "33", None, "22", "88", "0", "north", "126", "84")]


def cleaned(spark, tmp_path, text=DATASET, rows_=TABLE):
    (tmp_path / "d.yaml").write_text(text)
    (tmp_path / "m.yaml").write_text("models: {}")
    cfg = config.load(str(tmp_path / "d.yaml"), str(tmp_path / "m.yaml"))
    raw = spark.createDataFrame(rows_, ", ".join(f"KI{i} string" for i in range(1, 10)))
    return pipeline.clean(raw, cfg)


def test_sections(spark, tmp_path):
    res = cleaned(spark, tmp_path)
    html = report.render(res)
    for title in ("age derived from KI3", "BMI derived from height KI6 and weight KI5", "diastolic blood pressure KI9"):
        assert title in html
    assert "2 rows removed for an age that is unknown or below 20" in html
    assert "1 row removed for lacking an id" in html
    assert ">north</text>" in html and ">south</text>" in html
    assert tuple(res.audit.excluded.first()) == (2, 1)


def test_reference_year_of_a_variable_and_missing_columns(spark, tmp_path):
    res = cleaned(spark, tmp_path, DATASET.replace("reference_year: 2020", "reference_year: KI3"))
    v = next(v for v in res.cfg.variables if v.tag == "KI2")
    (_, pairs), = report.comparisons(res.df, v)
    assert sorted(tuple(r) for r in pairs.collect()) == [(30.0, 0.0), (41.0, 0.0)]
    with pytest.raises(ConfigError):
        report.comparisons(res.df.drop("KI3"), v)


def test_empty_table(spark, tmp_path):
    assert "No pairs of known values" in report.render(cleaned(spark, tmp_path, rows_=[("a", *[None] * 8)]))


def test_grid(spark):
    pairs = [(1.0, 2.0), (1.0, 2.0), (9.0, 4.0), (None, 4.0), (5.0, None)]
    got = sorted(tuple(r) for r in profile.grid(spark.createDataFrame(pairs, "p double, q double"), "p", "q", 4).collect())
    assert got == [(0, 0, 1.0, 2.0, 2), (3, 3, 7.0, 3.5, 1)]
    same = spark.createDataFrame([(3.0, 3.0)] * 5, "p double, q double")
    assert [tuple(r) for r in profile.grid(same, "p", "q").collect()] == [(0, 0, 3.0, 3.0, 5)]
    assert profile.grid(same.filter(F.lit(False)), "p", "q").count() == 0


def test_exclusion_counts(spark):
    df = spark.createDataFrame([("a", 30.0), (None, 30.0), (None, 3.0), ("b", None)], "id string, age double")
    assert tuple(rows.exclusion_counts(df, "id", "age", 18).first()) == (2, 1)
    assert tuple(rows.exclusion_counts(df, "id").first()) == (0, 2)
