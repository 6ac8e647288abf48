"""Helpers shared by the operators of this subpackage.

* ``pick`` selects columns by exact name, so extra columns whose names differ
  only in case, or repeat an operator's own names, never clash.
* ``scratch`` cuts lineage with a table written under the folder that the
  session names in ``spark.checkpoint.dir``; every executor sees it, so a lost
  executor costs a re-read, never a recomputation from nothing.
* ``sieved`` parts the rows that a join may change from the others, which then
  need no shuffle.
* ``bounded_join`` broadcasts a side only after its size was measured and falls
  back to a salted shuffle join beyond the bound.
"""

from __future__ import annotations

import functools
import operator
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: ASCII white space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Used only where the session names no folder of its own (tests, notebooks).
DEFAULT_WORK_DIR = "/tmp/checkpoints/quillsieve"
#: Upper bound of one Arrow batch sent to a Python worker.
ARROW_BATCH_BYTES = 32 << 20
#: Largest table, measured in bytes of its values, that is broadcast.
BROADCAST_BYTES = 8 << 20
#: Bits of the bitmap by which ``sieved`` tells keys apart; its words are 2 MB at most.
SIEVE_BITS = 23
#: A key with over one in so many of all rows, and over ``HOT_ROWS`` rows, is hot.
HOT_KEYS = 1024
HOT_ROWS = 4096


def work_dir(spark: SparkSession) -> str:
    """Shared folder for scratch tables, from ``spark.checkpoint.dir``."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = DEFAULT_WORK_DIR
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/quillsieve-{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables whose readers have all run."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(conf).delete(path, True)


def bound_arrow(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that very long texts never pile up in one batch.

    Python workers follow, so they get the package as well.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select ``new=old`` columns; an exact match wins over one in another case."""
    have = df.columns
    plain = df.toDF(*[f"__c{i}" for i in range(len(have))])
    out = []
    for new, old in names.items():
        at = [i for i, c in enumerate(have) if c == old] or [i for i, c in enumerate(have) if c.lower() == old.lower()]
        if not at:
            raise ValueError(f"no column {old!r} among {have}")
        out.append(F.col(f"__c{at[0]}").alias(new))
    return plain.select(*out)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(c, SPACE_CLASS + "+", -1), "")


def value_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and a bound on the bytes of their values (one aggregate row)."""
    size = functools.reduce(
        operator.add,
        [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 16 if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes],
        F.lit(0),
    )
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return int(n), int(b)


def merged_if_large(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` as a side of a join, never broadcast if its values, or ``rows`` rows of two longs, take over ``limit`` bytes.

    Left to itself Spark goes by the size of compressed files, which says little
    about the memory that the driver needs for the rows.
    """
    size = value_bytes(df)[1] if rows is None else 32 * rows
    return df.hint("merge") if size > limit else df


def sieved(df: DataFrame, key: Column, ids: DataFrame, name: str = "sieve") -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose hash ``key`` may be among those of ``ids`` (one column of longs), and all others.

    Every row whose key is there is in the first table, with a few whose key is
    not, so a join of the first alone loses nothing.  What is broadcast is a
    bitmap of fixed size, as rows of its words.
    """
    word = F.shiftright(F.col("__h").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1)), 6)
    bit = F.expr("shiftleft(1L, cast(__h & 63 as int))")
    words = ids.toDF("__h").select(word.alias("__w"), bit.alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__b"))
    words = F.broadcast(scratch(words, name).toDF("__kw", "__kb"))
    mine = df.withColumn("__h", key)
    mine = mine.withColumn("__w", word).join(words, F.col("__w") == F.col("__kw"), "left")
    hit = F.coalesce(F.col("__kb").bitwiseAND(bit) != 0, F.lit(False))
    return tuple(mine.filter(x).select(*[F.col(f"`{c}`") for c in df.columns]) for x in (hit, ~hit))


def bounded_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 32, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Null-safe equi-join of ``big`` with ``small``, which has one row per key.

    ``small`` should be a scratch table: its size is measured first.  Up to
    ``limit`` bytes it is broadcast; beyond that each of its rows is repeated
    for every salt and ``big`` is dealt out by key and salt, so a key that holds
    a third of all rows still spreads over ``salts`` tasks.  Spark would take the
    repeated rows for as small as their file and broadcast them, hence the hint.
    """
    right = small.toDF(*[f"__k_{c}" if c in keys else c for c in small.columns])
    on = functools.reduce(operator.and_, [big[k].eqNullSafe(right[f"__k_{k}"]) for k in keys])
    if value_bytes(small)[1] <= limit:
        return big.join(F.broadcast(right), on, how).drop(*[f"__k_{k}" for k in keys])
    big = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)))
    right = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    on = functools.reduce(operator.and_, [big[k].eqNullSafe(right[f"__k_{k}"]) for k in keys]) & (big["__salt"] == right["__salt_r"])
    return big.join(right.hint("merge"), on, how).drop("__salt", "__salt_r", *[f"__k_{k}" for k in keys])


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 32, counts: DataFrame | None = None) -> DataFrame:
    """Inner equi-join of ``big`` with ``small``, which has one row per key and no null keys.

    Keys are counted first, unless ``counts`` has how many rows ``n`` of ``big`` each key of ``small`` has.  Those with over one in ``HOT_KEYS`` of all rows,
    fewer than ``HOT_KEYS`` by that, are dealt out by salts, their
    rows of ``small`` repeated for each; the others meet by key alone.
    """
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    bound = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= bound:
        return big.join(small, keys)
    hot = scratch(counts.filter(F.col("n") > bound).select(*keys), "hot-keys")
    cold = big.join(F.broadcast(hot), keys, "left_anti").join(small, keys)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts))
    warm = big.join(F.broadcast(hot), keys, "left_semi").withColumn("__salt", salt)
    many = small.join(F.broadcast(hot), keys, "left_semi").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return cold.unionByName(warm.join(many, [*keys, "__salt"]).drop("__salt"))
