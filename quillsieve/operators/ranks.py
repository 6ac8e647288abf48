"""Rank-based inverse normal transform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.derive import normal_quantile


def rank_normal_column(x: Column, offset: float = 0.5, strata: Sequence[Column] = (), tie: Column | None = None) -> Column:
    """The transform of ``rank_normal`` as a window expression; ties follow ``tie``, else the order of rows."""
    known = x.isNotNull()
    for s in strata:
        known = known & s.isNotNull()
    part = [*strata, known]
    rank = F.row_number().over(W.partitionBy(*part).orderBy(x, *([] if tie is None else [tie])))
    n = F.count(F.lit(1)).over(W.partitionBy(*part))
    return F.when(known, normal_quantile((rank - F.lit(offset)) / n))


RANGES = 64  #: parts of a stratum that are ranked apart


def ranges(df: DataFrame, column: str) -> list[float]:
    """Distinct approximate quantiles, which cut the known values into ``RANGES`` parts at most; one aggregate."""
    x = F.col(f"`{column}`").cast("double")
    got = df.filter(~F.isnan(x)).agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 10000)).first()[0]
    return sorted(set(got or ()))


def ranked(df: DataFrame, column: str, out: str, strata: Sequence[str], offset: float, tie: str) -> DataFrame:
    """Adds ``out`` for each stratum without a sort of all its rows in one task.

    Values are cut into ranges, which are ranked apart; the numbers of rows of
    the ranges below, one row for each range and stratum, are added.
    """
    x = F.col(f"`{column}`")
    known = x.isNotNull()
    for s in strata:
        known = known & F.col(f"`{s}`").isNotNull()
    cuts = ranges(df, column)
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < x.cast("double"))) if cuts else F.lit(0)
    keys = [f"__s{i}" for i in range(len(strata))]
    placed = df.select("*", F.when(known, part).alias("__part"), *[F.when(known, F.col(f"`{s}`")).alias(k) for s, k in zip(strata, keys, strict=True)])
    counts = placed.filter("__part IS NOT NULL").groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    # RANGES rows a stratum
    below = W.partitionBy(*keys).orderBy("__part") if keys else W.partitionBy(F.lit(0)).orderBy("__part")
    counts = counts.select(*keys, "__part", (F.sum("__n").over(below.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__below"), F.sum("__n").over(below.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("__all"))
    rank = F.row_number().over(W.partitionBy(*keys, "__part").orderBy(x, F.col(tie))) + F.col("__below")
    joined = placed.filter("__part IS NOT NULL").join(counts, [*keys, "__part"])
    done = joined.select(*[F.col(f"`{c}`") for c in df.columns], normal_quantile((rank - F.lit(offset)) / F.col("__all")).alias(out))
    rest = placed.filter("__part IS NULL").select(*[F.col(f"`{c}`") for c in df.columns], F.lit(None).cast("double").alias(out))
    return done.unionByName(rest)


def rank_normal(df: DataFrame, column: str, out: str, strata: Sequence[str] = (), offset: float = 0.5, tie: Column | None = None, seed: int | None = None) -> DataFrame:
    """Adds ``out``: the normal quantile of (rank - offset) / count of non-null values.

    Ties are broken by ``tie`` (a stable order), or at random with ``seed``.
    With strata the transform runs within each combination of them, rows with a
    missing stratum have none, and a second transform runs over all results.
    """
    df = df.withColumn("__tie", F.rand(seed) if tie is None else tie)
    if strata:
        df = ranked(ranked(df, column, "__z", strata, offset, "__tie"), "__z", out, (), offset, "__tie").drop("__z")
    else:
        df = ranked(df, column, out, (), offset, "__tie")
    return df.drop("__tie")
