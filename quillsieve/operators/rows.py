"""Row filters and bounds over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ids(ids: DataFrame) -> DataFrame:
    return ids.select(F.col(f"`{ids.columns[0]}`").alias("__id")).filter(F.col("__id").isNotNull()).distinct()


def consent_exclude(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is not listed; a null id is on no list."""
    return df.join(_ids(ids), F.col(f"`{id_col}`") == F.col("__id"), "left_anti")


def consent_include(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    return df.join(_ids(ids), F.col(f"`{id_col}`") == F.col("__id"), "left_semi")


def consent(df: DataFrame, id_col: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Exclusion wins over inclusion; a list that is not given does not filter."""
    if exclude is not None:
        df = consent_exclude(df, id_col, exclude)
    return df if include is None else consent_include(df, id_col, include)


def consent_ambiguous(df: DataFrame, id_col: str, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """Distinct ids on neither list."""
    left = consent_exclude(consent_exclude(df, id_col, exclude), id_col, include)
    return left.select(F.col(f"`{id_col}`")).filter(F.col(f"`{id_col}`").isNotNull()).distinct()


def consent_counts(df: DataFrame, id_col: str, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """One row: rows at first, refused, agreed."""
    marked = df.join(_ids(exclude).withColumn("no", F.lit(True)), F.col(f"`{id_col}`") == F.col("__id"), "left").drop("__id")
    marked = marked.join(_ids(include).withColumn("yes", F.lit(True)), F.col(f"`{id_col}`") == F.col("__id"), "left")
    no, yes = F.coalesce("no", F.lit(False)), F.coalesce("yes", F.lit(False))
    return marked.agg(F.count(F.lit(1)).alias("n_initial"), F.count_if(no).alias("n_no"), F.count_if(~no & yes).alias("n_yes"))


def by_age(df: DataFrame, age_col: str, least: float) -> DataFrame:
    """Rows of at least this age; a missing age goes."""
    return df.filter(F.col(f"`{age_col}`") >= least)


def by_missing_id(df: DataFrame, id_col: str) -> DataFrame:
    return df.filter(F.col(f"`{id_col}`").isNotNull())


def exclusion_counts(df: DataFrame, id_col: str, age_col: str | None = None, least: float | None = None) -> DataFrame:
    """One row: rows that ``by_age`` takes out, and those of the others that ``by_missing_id`` does."""
    old = F.lit(True) if least is None else F.coalesce(F.col(f"`{age_col}`") >= least, F.lit(False))
    return df.agg(F.count_if(~old).alias("n_age"), F.count_if(old & F.col(f"`{id_col}`").isNull()).alias("n_id"))


def by_metric(df: DataFrame, id_col: str, metric: DataFrame, most: float | None) -> DataFrame:
    """Rows whose id's metric, the second column of ``metric``, is not over ``most``; unlisted ids have 0."""
    if most is None:
        return df
    k, n = metric.columns[:2]
    over = metric.filter(F.col(f"`{n}`") > most).select(F.col(f"`{k}`"))
    return consent_exclude(df, id_col, over)


def clip_null(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Values strictly outside the bounds become null."""
    outside = F.lit(False)
    if lo is not None:
        outside = outside | (c < lo)
    if hi is not None:
        outside = outside | (c > hi)
    return F.when(~outside, c)


def bounds(df: DataFrame, limits: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Min, max and sd bounds of several columns in two projections and one aggregate.

    ``sd`` is in standard deviations from the mean of what min and max leave.
    """
    low_high = {c: clip_null(F.col(f"`{c}`"), b.get("min"), b.get("max")) for c, b in limits.items()}
    df = df.select(*[low_high.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
    spread = {c: b["sd"] for c, b in limits.items() if b.get("sd") is not None}
    if not spread:
        return df
    for c, k in spread.items():
        if k < 0:
            raise ValueError(f"{c}: a bound in standard deviations is negative")
    stats = df.agg(*[f(F.col(f"`{c}`")).alias(f"__{n}_{i}") for i, c in enumerate(spread) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    out = {}
    for i, (c, k) in enumerate(spread.items()):
        x = F.col(f"`{c}`")
        m, s = F.col(f"__m_{i}"), F.col(f"__s_{i}")
        out[c] = F.when(~F.coalesce((x < m - k * s) | (x > m + k * s), F.lit(False)), x)
    return joined.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def bounds_counts(df: DataFrame, limits: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(variable, n_below, n_above, n_beyond_sd), all variables in one pass over the bounded table."""
    after = bounds(df, {c: {k: v for k, v in b.items() if k != "sd"} for c, b in limits.items()})
    both = df.select(*[F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(limits)]).alias("__raw")])
    aggs = []
    for i, (c, b) in enumerate(limits.items()):
        x = F.col(f"__raw.v{i}")
        aggs += [F.count_if(x < b["min"] if b.get("min") is not None else F.lit(False)).alias(f"b{i}"), F.count_if(x > b["max"] if b.get("max") is not None else F.lit(False)).alias(f"a{i}")]
    row = both.agg(*aggs)
    full = bounds(after, {c: {"sd": b.get("sd")} for c, b in limits.items()})
    kept = after.agg(*[F.count(F.col(f"`{c}`")).alias(f"x{i}") for i, c in enumerate(limits)])
    left = full.agg(*[F.count(F.col(f"`{c}`")).alias(f"y{i}") for i, c in enumerate(limits)])
    wide = row.crossJoin(kept).crossJoin(left)  # three single rows
    parts = ", ".join(f"'{c}', b{i}, a{i}, x{i} - y{i}" for i, c in enumerate(limits))
    return wide.selectExpr(f"stack({len(limits)}, {parts}) AS (variable, n_below, n_above, n_beyond_sd)")
