"""Fuzzy harmonisation of free-text labels against a dictionary of aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.derive import osa_similarity
from ..shipping import ship

TOO_LOW = "top match quality too low"
CONCORDANT = "low discernment but top matches concordant"
DISCORDANT = "low discernment between discordant calls"


def top_two(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """For each distinct value its best two aliases; ties go to the earlier alias.

    ``values`` has one column ``value``; ``dictionary`` has alias, label and ord.
    Only distinct values are compared, and only aliases whose length alone allows
    a similarity over 0 reach the comparison.
    """
    ship(values.sparkSession)
    pairs = values.distinct().join(F.broadcast(dictionary), F.length("value") * 1000000 >= F.length("alias"))
    scored = pairs.withColumn("sim", osa_similarity("value", "alias"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("value").orderBy(F.desc("sim"), "ord"))).filter("rank <= 2")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return ranked.groupBy("value").agg(pick(1, "alias").alias("top"), pick(1, "sim").alias("top_sim"), pick(1, "label").alias("top_label"), pick(2, "alias").alias("second"), pick(2, "sim").alias("second_sim"), pick(2, "label").alias("second_label"))


def decide(two: DataFrame, threshold: float = 0.9, discernment: float = 0.75) -> DataFrame:
    """Adds label (null if rejected) and reasoning."""
    low = F.col("top_sim") < threshold
    close = ~low & F.coalesce(F.col("second_sim") >= discernment * F.col("top_sim"), F.lit(False))
    same = F.col("top_label") == F.col("second_label")
    reason = F.when(low, TOO_LOW).when(close & same, CONCORDANT).when(close, DISCORDANT).otherwise("success")
    return two.withColumn("label", F.when(~low & ~(close & ~same), F.col("top_label"))).withColumn("reasoning", reason)


def decisions(df: DataFrame, column: str, dictionary: DataFrame, threshold: float = 0.8, discernment: float = 0.75) -> DataFrame:
    """(value, label, reasoning, ...) for the distinct values: exact hits first, else the fuzzy match."""
    values = df.select(F.col(f"`{column}`").alias("value")).filter(F.col("value").isNotNull()).distinct()
    exact = values.join(F.broadcast(dictionary), F.col("value") == F.col("alias")).select("value", "label", F.lit("exact").alias("reasoning"))
    missed = values.join(F.broadcast(dictionary), F.col("value") == F.col("alias"), "left_anti")
    fuzzy = decide(top_two(missed, dictionary), threshold, discernment)
    return exact.unionByName(fuzzy, allowMissingColumns=True)


def harmonize(df: DataFrame, column: str, dictionary: DataFrame, threshold: float = 0.8, discernment: float = 0.75) -> DataFrame:
    """Replaces the column's values by their labels."""
    d = decisions(df, column, dictionary, threshold, discernment).select(F.col("value").alias("__v"), F.col("label").alias("__label"))
    joined = df.join(d, F.col(f"`{column}`") == F.col("__v"), "left")
    return joined.select(*[(F.col("__label") if c == column else F.col(f"`{c}`")).alias(c) for c in df.columns])


def harmonize_counts(df: DataFrame, column: str, dictionary: DataFrame, threshold: float = 0.8, discernment: float = 0.75) -> DataFrame:
    """One row: cells that hit exactly, by similarity, and not at all."""
    d = decisions(df, column, dictionary, threshold, discernment)
    joined = df.select(F.col(f"`{column}`").alias("value")).filter(F.col("value").isNotNull()).join(d, "value")
    return joined.agg(F.count_if(F.col("reasoning") == "exact").alias("n_perfect"), F.count_if((F.col("reasoning") != "exact") & F.col("label").isNotNull()).alias("n_imperfect"), F.count_if(F.col("label").isNull()).alias("n_failed"))


def report(df: DataFrame, column: str, dictionary: DataFrame, threshold: float = 0.8, discernment: float = 0.75) -> DataFrame:
    """One row for each input that did not hit exactly, with its count, in the order of a report."""
    d = decisions(df, column, dictionary, threshold, discernment).filter("reasoning <> 'exact'")
    n = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(d, "value").select("value", "n", "label", "reasoning", "top", F.round("top_sim", 2).alias("top_sim"), "second", F.round("second_sim", 2).alias("second_sim")).orderBy("reasoning", "label", "value")
