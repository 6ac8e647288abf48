"""Profiles: summaries, counts, histograms and audits, each in a constant number of jobs."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = [i / 10 for i in range(11)]
SUMMARY = ["mean", "min", "p10", "p20", "p30", "p40", "median", "p60", "p70", "p80", "p90", "max", "n_null"]
MOST_BINS = 50


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each variable: mean, eleven exact quantiles and the number of nulls, all in one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.percentile(x, QUANTILES).alias(f"q{i}"), F.count_if(x.isNull()).alias(f"n{i}")]
    row = df.agg(*aggs)
    parts = ", ".join(f"'{c}', m{i}, " + ", ".join(f"q{i}[{k}]" for k in range(11)) + f", n{i}" for i, c in enumerate(columns))
    return row.selectExpr(f"stack({len(columns)}, {parts}) AS (variable, {', '.join(SUMMARY)})")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value, n) with a row for null where there is one; all variables in one shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).groupBy("p.variable", "p.value").agg(F.count(F.lit(1)).alias("n"))


def level_counts(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """(value, n) for every level, those without rows included, and for null if any."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(k, x) for k, x in enumerate(levels)], "ord int, value string")
    counts = df.groupBy(F.col(f"`{column}`").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    joined = F.broadcast(dim).join(counts, F.col("value") == F.col("v"), "full")
    return joined.select(F.coalesce("value", "v").alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n), null as a value of its own."""
    return df.groupBy(F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def null_cells(columns: Sequence[str]) -> Column:
    """Null cells of a row."""
    return functools.reduce(operator.add, [F.col(f"`{c}`").isNull().cast("long") for c in columns])


def null_counts_by_subject(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("subject_id"), null_cells(df.columns).alias("n"))


def wrong_type_by_subject(df: DataFrame, id_col: str, flags: Mapping[str, Column]) -> DataFrame:
    """(subject_id, n): variables of the wrong type, subjects with none left out."""
    n = functools.reduce(operator.add, [c.cast("long") for c in flags.values()])
    return df.select(F.col(f"`{id_col}`").alias("subject_id"), n.alias("x")).groupBy("subject_id").agg(F.sum("x").alias("n")).filter("n > 0")


def wrong_type_by_variable(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """(variable, n): rows of the wrong type, variables with none kept; one pass."""
    row = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(flags.values())])
    return row.selectExpr(f"stack({len(flags)}, {', '.join(f"'{v}', n{i}" for i, v in enumerate(flags))}) AS (variable, n)")


def rejected_entries(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """(value, n) of entries that did not convert."""
    return df.select(before.alias("value"), after.alias("x")).filter("value IS NOT NULL AND x IS NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, column: str, tie: str, decreasing: bool = True, n: int = 10) -> DataFrame:
    """The first ``n`` rows by the column, ties by another."""
    c = F.col(f"`{column}`")
    return df.orderBy(c.desc_nulls_last() if decreasing else c.asc_nulls_last(), F.col(f"`{tie}`")).limit(n)


def bin_count(df: DataFrame, column: str) -> DataFrame:
    """One row: bins of a histogram, the number of distinct values (null is one), 50 at most."""
    x = F.col(f"`{column}`")
    return df.agg(F.least(F.lit(MOST_BINS), F.countDistinct(x) + F.max(x.isNull().cast("int"))).cast("long").alias("bins"))


def histogram(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """(bin, from, n, share) with bins of equal width (range + 1) / bins from the least value on.

    Bins are as many as the distinct known values, 50 at most.

    With ``by``, counts are for each of its values.
    """
    x = F.col(f"`{column}`").cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("all"), F.countDistinct(x).alias("d"))
    ends = ends.select("lo", "all", ((F.col("hi") - F.col("lo") + 1) / F.least(F.lit(MOST_BINS), F.col("d"))).alias("w"))
    group = [F.col(f"`{by}`").alias("group")] if by else []
    placed = df.select(x.alias("x"), *group).filter("x IS NOT NULL").crossJoin(F.broadcast(ends))  # one row
    bin_ = F.floor((F.col("x") - F.col("lo")) / F.col("w")).cast("long").alias("bin")
    out = placed.groupBy(*(["group"] if by else []), bin_).agg(F.min("lo").alias("lo"), F.min("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("all").alias("all"))
    return out.select(*(["group"] if by else []), "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("start"), "n", (F.col("n") / F.col("all")).alias("share"))


def group_means(df: DataFrame, column: str, by: str) -> DataFrame:
    """(group, mean, n) of each known value of ``by``."""
    return df.filter(F.col(f"`{by}`").isNotNull()).groupBy(F.col(f"`{by}`").cast("string").alias("group")).agg(F.avg(F.col(f"`{column}`").cast("double")).alias("mean"), F.count(F.col(f"`{column}`")).alias("n"))


def sd_guides(df: DataFrame, column: str, k: float = 3) -> DataFrame:
    """One row: mean less and plus ``k`` standard deviations."""
    x = F.col(f"`{column}`").cast("double")
    return df.agg((F.avg(x) - k * F.stddev_samp(x)).alias("low"), (F.avg(x) + k * F.stddev_samp(x)).alias("high"))


def shows_table(df: DataFrame, columns: Sequence[str], share: float = 1 / 3) -> DataFrame:
    """(variable, n_unique, n_rows, shown): a table of values is shown if few of them are unique."""
    # known values once for each variable, then their number; a row for null keeps variables that have none
    each = value_counts(df, columns)
    out = each.groupBy("variable").agg(F.count("value").alias("n_unique"), F.sum("n").alias("n_rows"))
    empty = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    out = F.broadcast(empty).join(out, "variable", "left").select("variable", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
    return out.withColumn("shown", F.col("n_unique") < F.col("n_rows") * share)


def year_pairs(df: DataFrame, age: str, year: str, reference: Column) -> DataFrame:
    """(reported, computed): age against reference year less reported year, where all are known."""
    return df.select(F.col(f"`{age}`").cast("double").alias("reported"), (reference - F.col(f"`{year}`")).cast("double").alias("computed")).dropna()


def bmi_pairs(df: DataFrame, bmi: str, weight: str, height: str) -> DataFrame:
    h = F.col(f"`{height}`").cast("double")
    return df.select(F.col(f"`{bmi}`").cast("double").alias("reported"), F.try_divide(F.col(f"`{weight}`").cast("double"), h * h).alias("computed")).dropna()


def pressure_pairs(df: DataFrame, systolic: str, diastolic: str) -> DataFrame:
    return df.select(F.col(f"`{systolic}`").cast("double").alias("systolic"), F.col(f"`{diastolic}`").cast("double").alias("diastolic")).dropna()


def grid(pairs: DataFrame, x: str, y: str, steps: int = 60) -> DataFrame:
    """(i, j, x, y, n): pairs of known values by cells of a grid from the least values on, the least values of each cell with them.

    Every pair is counted, and there are ``steps`` squared rows at most, however many the pairs.
    """
    known = pairs.select(F.col(f"`{x}`").cast("double").alias("a"), F.col(f"`{y}`").cast("double").alias("b")).dropna()
    width = lambda c: ((F.max(c) - F.min(c)) / steps).alias(f"w{c}")
    ends = known.agg(F.min("a").alias("la"), width("a"), F.min("b").alias("lb"), width("b"))
    step = lambda c: F.when(F.col(f"w{c}") > 0, F.least(F.lit(steps - 1), F.floor((F.col(c) - F.col(f"l{c}")) / F.col(f"w{c}")))).otherwise(F.lit(0)).cast("long")
    placed = known.crossJoin(F.broadcast(ends))  # one row
    out = placed.groupBy(step("a").alias("i"), step("b").alias("j")).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("la", "wa", "lb", "wb")])
    return out.select("i", "j", (F.col("la") + F.col("i") * F.col("wa")).alias("x"), (F.col("lb") + F.col("j") * F.col("wb")).alias("y"), "n")
