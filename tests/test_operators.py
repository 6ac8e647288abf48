import pytest
from pyspark.sql import functions as F

from quillsieve.operators import depend, labels, profile, ranks, rows
from quillsieve.sources.read import parse_dictionary


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()), key=str)


def test_consent(spark):
    df = spark.createDataFrame([(x,) for x in ["oak", "elm", "fir", "ash", None, "yew"]], "id string")
    inc, exc = spark.createDataFrame([("yew",), ("oak",), ("elm",), ("box",)], "id string"), spark.createDataFrame([("fir",), ("elm",)], "id string")
    empty = spark.createDataFrame([], "id string")
    assert values(rows.consent(df, "id", inc, exc), "id") == ["oak", "yew"]
    assert values(rows.consent(df, "id", exclude=exc), "id") == [None, "ash", "oak", "yew"]
    assert values(rows.consent(df, "id", include=empty), "id") == []
    assert rows.consent(df, "id", exclude=empty).count() == 6
    assert values(rows.consent_ambiguous(df, "id", inc, exc), "id") == ["ash"]
    n = rows.consent_counts(df, "id", inc, exc).first()
    assert tuple(n) == (6, 2, 2)


def test_filters_and_metric(spark):
    df = spark.createDataFrame([("oak", 61.0), ("elm", 25.0), (None, 70.5), ("fir", None), ("ash", 24.9)], "id string, age double")
    assert values(rows.by_age(df, "age", 25), "id") == [None, "elm", "oak"]
    assert values(rows.by_missing_id(df, "id"), "id") == ["ash", "elm", "fir", "oak"]
    metric = spark.createDataFrame([("oak", 3), ("fir", 4), ("yew", 9)], "id string, n int")
    assert values(rows.by_metric(df, "id", metric, 3), "id") == [None, "ash", "elm", "oak"]
    assert rows.by_metric(df, "id", metric, None).count() == 5


def test_bounds(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 1000]] + [(None,)], "x double")
    assert [r.x for r in rows.bounds(df, {"x": {"min": 2, "max": 8}}).filter("x is not null").orderBy("x").collect()] == [2, 3, 4, 5, 6, 7, 8]
    # the sd bound is computed on what min and max leave
    both = rows.bounds(df, {"x": {"max": 100, "sd": 1}})
    assert values(both.filter("x is not null"), "x") == [3.0, 4.0, 5.0, 6.0]
    assert values(rows.bounds(df, {"x": {"sd": 2}}).filter("x is not null"), "x") == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    c = rows.bounds_counts(df, {"x": {"min": 2, "max": 100, "sd": 1}}).first()
    assert (c.n_below, c.n_above, c.n_beyond_sd) == (1, 1, 2)
    with pytest.raises(ValueError):
        rows.bounds(df, {"x": {"sd": -1}})


def test_failures_spread_over_equal_ids(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 9, 2.0), ("b", 1, 3.0), ("c", None, 4.0)], "id string, x int, y double")
    rules = [depend.Rule("x", "d", F.col("x") < 5, exclude=("y",)), depend.Rule("y", "e", F.col("y") < 4, exclude=("x",))]
    assert values(depend.failures(df, "id", rules), "subject_id", "variable", "dependency") == [("a", "x", "d"), ("c", "y", "e")]
    assert values(depend.null_failures(df, "id", rules), "id", "x", "y") == [("a", 1, None), ("a", 9, None), ("b", 1, 3.0), ("c", None, 4.0)]
    assert tuple(depend.null_counts(df, "id", rules).first()) == (2, 8)
    every = depend.null_failures(df, "id", [depend.Rule("x", "d", F.col("x") < 5, exclude_all=True)])
    assert values(every, "id", "x", "y") == [("a", None, None), ("a", None, None), ("b", 1, 3.0), ("c", None, 4.0)]
    assert values(depend.failures_by_subject(depend.failures(df, "id", rules)), "subject_id", "n") == [("a", 1), ("c", 1)]
    assert values(depend.rule_report(df, "id", rules), "variable", "n_failures", "ids") == [("x", 1, "a"), ("y", 1, "c")]


def test_every_failing_id_is_listed(spark):
    df = spark.createDataFrame([(f"s{i:03}", i) for i in [*range(200), 7]], "id string, x int")
    rules = [depend.Rule("x", "d", F.col("x") >= 150)]
    assert values(depend.failed_ids(df, "id", rules), "subject_id", "n_rows") == [(f"s{i:03}", 1 + (i == 7)) for i in range(150)]


def test_rank_normal(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None, s) for i, (v, s) in enumerate([(5, "a"), (1, "a"), (3, "a"), (2, "b"), (4, None), (None, "a")])], "i int, x double, s string")
    got = {r.i: r.z for r in ranks.rank_normal(df, "x", "z", tie=F.col("i")).collect()}
    assert [got[i] for i in (1, 3, 2, 4, 0)] == pytest.approx([-1.2815516, -0.5244005, 0, 0.5244005, 1.2815516], abs=1e-6)
    assert got[5] is None
    by = {r.i: r.z for r in ranks.rank_normal(df, "x", "z", ["s"], tie=F.col("i")).collect()}
    assert by[4] is None and by[5] is None and by[1] < by[2] < by[0]
    seeded = [[r.z for r in ranks.rank_normal(df, "x", "z", seed=7).orderBy("i").collect()] for _ in range(2)]
    assert seeded[0] == seeded[1]


def test_labels(spark):
    d = spark.createDataFrame(parse_dictionary(["Hausa [Hausawa, Habe]", "Yoruba", "Fulani [Fula]", "Belarusian"]), "alias string, label string, ord int")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["hausa", "habe", "yorubas", "belorussian", "qqqq", None, "fulan", "hausawe"])], "i int, x string")
    got = {r.i: r.x for r in labels.harmonize(df, "x", d).collect()}
    assert got == {0: "hausa", 1: "hausa", 2: "yoruba", 3: "belarusian", 4: None, 5: None, 6: "fulani", 7: "hausa"}
    why = {r.value: r.reasoning for r in labels.decisions(df, "x", d).collect()}
    assert why["qqqq"] == labels.TOO_LOW and why["hausawe"] == labels.CONCORDANT and why["hausa"] == "exact" and why["yorubas"] == "success"
    two = {r.value: r for r in labels.top_two(spark.createDataFrame([("belorussian",)], "value string"), d).collect()}
    assert two["belorussian"].top_sim == pytest.approx(0.8181818)
    assert tuple(labels.harmonize_counts(df, "x", d).first()) == (2, 4, 1)
    clash = spark.createDataFrame([("abcd", "one", 0), ("abce", "two", 1)], "alias string, label string, ord int")
    r = labels.decisions(spark.createDataFrame([("abcf",)], "x string"), "x", clash, 0.7).first()
    assert r.label is None and r.reasoning == labels.DISCORDANT


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0, "u"), ("b", 2.0, None), ("c", None, "u"), ("d", 4.0, "v"), ("e", 10.0, "u")], "id string, x double, g string")
    s = profile.numeric_summary(df, ["x"]).first()
    assert (s["mean"], s["min"], s["median"], s["max"], s["n_null"]) == (4.25, 1.0, 3.0, 10.0, 1)
    assert s["p10"] == pytest.approx(1.3)
    assert values(profile.value_counts(df, ["g"]), "value", "n") == [("u", 3), ("v", 1), (None, 1)]
    assert values(profile.level_counts(df, "g", ["u", "v", "w"]), "value", "n") == [("u", 3), ("v", 1), ("w", 0), (None, 1)]
    assert values(profile.null_counts_by_subject(df, "id"), "subject_id", "n") == [("a", 0), ("b", 1), ("c", 1), ("d", 0), ("e", 0)]
    assert profile.bin_count(df, "x").first().bins == 5
    h = profile.histogram(df, "x")
    assert h.agg(F.sum("n")).first()[0] == 4 and h.agg(F.max("bin")).first()[0] <= 4
    assert values(profile.contingency(df, "g", "id"), "n") == [1] * 5
    assert [r.id for r in profile.top(df, "x", "id", n=2).collect()] == ["e", "d"]
    assert {r.variable: r.shown for r in profile.shows_table(df, ["id", "g"], 0.5).collect()} == {"id": False, "g": True}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id string, x double, g string")
    assert profile.numeric_summary(df, ["x"]).first()["n_null"] == 0
    assert rows.bounds(df, {"x": {"min": 1, "sd": 2}}).count() == 0
    assert ranks.rank_normal(df, "x", "z", ["g"], tie=F.col("id")).count() == 0
    assert depend.null_failures(df, "id", [depend.Rule("x", "d", F.col("x") < 5, exclude=("x",))]).count() == 0


def test_one_pass_for_many_variables(spark):
    """The plan of a summary has one aggregate pair whatever the number of variables."""
    df = spark.range(5).select("id", *[(F.col("id") * k).cast("double").alias(f"v{k}") for k in range(200)])
    plan = profile.numeric_summary(df, df.columns[1:])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "BroadcastNestedLoop" not in plan
    counts = profile.value_counts(df, df.columns[1:])._jdf.queryExecution().executedPlan().toString()
    assert counts.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2.0 as age", "'x' as other").write.parquet(str(tmp_path / "p"))
    plan = rows.by_age(spark.read.parquet(str(tmp_path / "p")).select("id", "age"), "age", 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(age,5" in plan and "other" not in plan


def test_histogram_of_few_values(spark):
    """Null is no value: bins are as many as the known values."""
    df = spark.createDataFrame([(x, "g" if x else None) for x in (1.0, 1.0, 2.0, 5.0, None, None)], "x double, g string")
    h = values(profile.histogram(df, "x"), "bin", "start", "n")
    assert [(b, n) for b, _, n in h] == [(0, 3), (2, 1)] and h[1][1] == pytest.approx(1 + 2 * 5 / 3)
    assert values(profile.group_means(df, "x", "g"), "group", "n") == [("g", 4)]


def test_ranks_need_no_single_task(spark):
    df = spark.createDataFrame([(i, float(i * 37 % 1000) if i % 10 else None, "ab"[i % 2]) for i in range(1000)], "i int, x double, s string")
    out = ranks.rank_normal(df, "x", "z", tie=F.col("i"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(__part" in plan  # only the sums over ranges meet in one task
    got = {r.x: r.z for r in out.collect()}
    order = sorted(x for x in got if x is not None)
    assert all(got[a] < got[b] for a, b in zip(order, order[1:], strict=False)) and got[None] is None
    assert [r.z for r in ranks.rank_normal(spark.createDataFrame([(None,)], "x double"), "x", "z").collect()] == [None]
