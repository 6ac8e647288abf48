"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Every source gets a target number of words (``water_fill``).  A source whose
target is r times its size takes floor(r) whole copies of each document for
certain; the rest is a Pareto sample without replacement: documents are ranked
by their random odds over their inclusion odds, and the first are taken until
the remaining words are reached, the last one only if that comes nearer.
Inclusion probabilities are unequal: within a source they rise with the length
class of a document (``length_weight``), scaled so that the expected words are
the remaining words, and at most 1.

Random numbers are a hash of the document's id, so reruns agree.  No source's
documents meet in one task: words are summed for each of ``BUCKETS`` slices of
the rank, and only the slice that holds the cut is ordered row by row.

Defined results: a null text has size 0; null sources are one source, last in
order; documents of size 0 take no words; null ids share one random number;
repeated rows are documents of their own; if all sizes are 0, all targets are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, bounded_join, scratch

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"
BUCKETS = 4096


def water_fill(df: DataFrame, by: Sequence[str], weight: str, cap: str, total: str, out: str) -> DataFrame:
    """Adds ``out``: shares of ``total`` by ``weight``, none over ``cap``, the excess reshared.

    In order of cap over weight, the level is the greatest of (total less the
    caps before a row) over (the weights from it on).
    """
    order = W.partitionBy(*by).orderBy(F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(0.0)), *[c for c in ("source", "class") if c in df.columns])
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(order.rowsBetween(0, W.unboundedFollowing))
    level = F.when(rest > 0, (F.col(total) - before) / rest).otherwise(F.lit(0.0))
    df = df.withColumn("__level", level)
    top = F.max("__level").over(W.partitionBy(*by))
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.col(cap), top * F.col(weight)))).drop("__level")


def unit_random(key: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit("\x00"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def length_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size.cast("double") + 0.5))).otherwise(F.lit(0)).cast("int")


def length_weight(k: Column) -> Column:
    """Relative inclusion weight of length class ``k`` (documents of 2^k to 2^(k+1) words)."""
    return F.lit(1.0) + k.cast("double") / 8.0


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, keep_text: bool = True) -> DataFrame:
    """``docs`` under names __d0, __d1, ... with source, size, source_size, target, copies and taken.

    Statistics are taken from a table of sizes without the texts; with
    ``keep_text`` False the text column is left out of the result as well.
    """
    names = docs.columns
    inner = docs.toDF(*[f"__d{i}" for i in range(len(names))])
    at = lambda c: F.col(f"__d{names.index(c)}")
    size = F.regexp_count(F.coalesce(at(text_col), F.lit("")), F.lit("[^" + SPACE_CLASS[1:] + "+")).cast("long")
    base = inner.withColumn("size", size).withColumn("source", at(source_col)).withColumn("__u", unit_random(at(id_col))).withColumn("class", length_class(F.col("size")))
    lean = scratch(base.drop(f"__d{names.index(text_col)}"), "mix-sizes")
    full = base if keep_text else lean

    classes = scratch(lean.groupBy("source", "class").agg(F.sum("size").cast("double").alias("class_size")), "mix-classes")
    sources = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(nth - 1, F.lit(len(weights))) + 1))
    sources = sources.withColumn("total", F.sum("source_size").over(W.partitionBy())).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    sources = water_fill(sources, [], "weight", "cap", "total", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("double")
    sources = scratch(sources.select("source", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest")), "mix-sources")

    # inclusion probabilities of the rest, for each source and length class
    odds = classes.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).withColumn("w", length_weight(F.col("class")) * F.col("class_size"))
    odds = water_fill(odds, ["source"], "w", "class_size", "rest", "share")
    p = F.when(F.col("class_size") > 0, F.col("share") / F.col("class_size")).otherwise(F.lit(0.0))
    odds = scratch(odds.select("source", "class", "source_size", "target", "whole", "rest", p.alias("p")), "mix-odds")

    def ranks(rows: DataFrame) -> DataFrame:
        """Random odds over inclusion odds, mapped to 0..1."""
        u, p = F.col("__u"), F.col("p")
        rank = F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(1.0)).otherwise(u * (1 - p) / (u * (1 - p) + p * (1 - u)))
        out = bounded_join(rows, odds, ["source", "class"])
        return out.withColumn("__rank", rank).withColumn("__bucket", F.floor(F.col("__rank") * BUCKETS).cast("int"))

    sums = ranks(lean).groupBy("source", "__bucket").agg(F.sum("size").cast("double").alias("n"), F.first("rest").alias("rest"))
    order = W.partitionBy("source").orderBy("__bucket")
    upto = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))
    cuts = sums.withColumn("upto", upto).filter((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")))
    cuts = cuts.groupBy("source").agg(F.min(F.struct(F.col("__bucket").alias("cut"), (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"))).alias("c"))
    cuts = scratch(cuts.select("source", "c.cut", "c.left"), "mix-cuts")

    # no cut: nothing is left to take, or (by rounding) all that is left
    ranked = bounded_join(ranks(full), cuts, ["source"])
    whole_slices = ranked.filter(F.col("cut").isNull() | (F.col("__bucket") != F.col("cut")))
    taken_slice = F.when(F.col("cut").isNull(), (F.col("rest") > 0) & (F.col("p") > 0)).otherwise(F.col("__bucket") < F.col("cut"))
    border = ranked.filter(F.col("__bucket") == F.col("cut"))
    line = W.partitionBy("source").orderBy("__rank", *[F.col(f"__d{names.index(id_col)}")], "size")
    upto = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0))
    border = border.withColumn("__take", (2 * upto - F.col("size")) <= 2 * F.col("left"))
    both = whole_slices.withColumn("__take", taken_slice).unionByName(border)
    copies = (F.col("whole") + F.col("__take").cast("int")).cast("long")
    kept = [c for c in inner.columns if keep_text or c != f"__d{names.index(text_col)}"]
    return both.select(*kept, "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) for every document."""
    from .common import pick

    out = mix(pick(docs, id=id_col, text=text_col, source=source_col).select("id", "text", "source"), "id", "text", "source", keep_text=False)
    return out.select(F.col("__d0").alias(id_col), "size", "source_size", "target", "taken", "copies")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each document as many times as it is taken, columns unchanged."""
    out = mix(docs, id_col, text_col, source_col)
    return out.withColumn("__copy", F.explode(F.expr("sequence(1, greatest(copies, 1))"))).filter("copies > 0").select(*[f"__d{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
