"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

``scan`` finds candidates in whole texts: the base kinds, which always stay, and
opaque tokens.  ``ownership`` counts for each candidate's hash the distinct
owners and repositories that hold it.  Opaque tokens that belong to few owners
and few repositories and look alive, by the entropy of their characters, are
added as spans of kind ``live``; values that many owners or many repositories
share are copied examples.

Spans are code points, end exclusive.  They come from lengths: matches are
fenced with a control character (one already in a text is read as another,
which no pattern takes), the text is split there, and lengths are summed up.

Defined results: a null text is empty and has no spans; null owners and
repositories are values of their own; repeated rows get equal results and count
once as a repository; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, pick, scratch

FENCE, OTHER = "\x01", "\x02"
#: Kind, pattern, group that holds the value, least length of the value.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
OPAQUE = ("live", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 0, 20)
COPIED_OWNERS = 3  #: owners from which a value is a copied example
COPIED_REPOSITORIES = 10  #: repositories from which it is one as well, even of one owner
#: Least entropy of a value that looks alive, in bits a character: with digits and letters, with letters alone.
#: Digits alone have 3.32 at most; words and names of 20 letters have less than 3.5, longer ones less than 4.
LIVE_ENTROPY, LIVE_ENTROPY_LETTERS = 3.5, 4.0
BLOCK = 128


def _starts(lengths: Column) -> Column:
    """Running sums before each element, in blocks, so that long arrays stay cheap."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    part = lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK)
    total = lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: a + x)
    empty = F.expr("cast(array() as array<int>)")
    grow = lambda a, x: F.struct((a["t"] + x).alias("t"), F.array_append(a["s"], a["t"]).alias("s"))
    heads = F.aggregate(F.transform(blocks, total), F.struct(F.lit(0).alias("t"), empty.alias("s")), grow, lambda a: a["s"])
    return F.flatten(F.transform(heads, lambda t, b: F.aggregate(part(b), F.struct(t.alias("t"), empty.alias("s")), grow, lambda a: a["s"])))


def _long(least: int) -> Callable[[Column], Column]:
    return lambda s: F.length(s["value"]) >= least


def _alive(s: Column) -> Column:
    """Whether a span's value has the entropy of a key."""
    v = s["value"]
    n = F.length(v).cast("double")
    part = lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(v, "")), F.lit(0.0), lambda a, c: a - part(c) * F.log2(part(c)))
    return entropy >= F.when(v.rlike("[0-9]") & v.rlike("[A-Za-z]"), F.lit(LIVE_ENTROPY)).otherwise(F.lit(LIVE_ENTROPY_LETTERS))


def _span(k: int, kind: str, pattern: str, group: int) -> Callable[[Column], Column]:
    """Of the k-th kind's split text, part i as a span."""

    def span(i: Column) -> Column:
        part, start = F.get(f"__p{k}", i), F.get(f"__s{k}", i)
        value = F.regexp_extract(part, pattern, group) if group else part
        return F.struct(start.alias("start"), F.lit(k).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(part)).alias("end"), value.alias("value"))

    return span


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``spans``: an array of (start, rank, kind, end, value)."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    t = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), FENCE, OTHER)
    kinds = [*KINDS, OPAQUE]
    fenced = docs.select(*keep, *[F.regexp_replace(t, p, f"{FENCE}$0{FENCE}").alias(f"__r{k}") for k, (_, p, _, _) in enumerate(kinds)])
    split = fenced.select(*keep, *[F.when(F.instr(f"__r{k}", FENCE) > 0, F.split(f"__r{k}", FENCE, -1)).alias(f"__p{k}") for k in range(len(kinds))])
    sized = split.select(*keep, *[f"__p{k}" for k in range(len(kinds))], *[F.transform(f"__p{k}", lambda x: F.length(x)).alias(f"__n{k}") for k in range(len(kinds))])
    placed = sized.select(*keep, *[f"__p{k}" for k in range(len(kinds))], *[F.when(F.col(f"__n{k}").isNotNull(), _starts(F.col(f"__n{k}"))).alias(f"__s{k}") for k in range(len(kinds))])
    found = []
    for k, (kind, pattern, group, least) in enumerate(kinds):
        odd = F.when(F.col(f"__p{k}").isNotNull(), F.transform(F.sequence(F.lit(1), F.size(f"__p{k}") - 2, F.lit(2)), _span(k, kind, pattern, group))).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,value:string>>)"))
        found.append(F.filter(odd, _alive if kind == OPAQUE[0] else _long(least)))
    out = placed.select(*keep, *[x.alias(f"__f{k}") for k, x in enumerate(found)])
    base = F.concat(*[F.col(f"__f{k}") for k in range(len(KINDS))])
    clear = F.filter(f"__f{len(KINDS)}", lambda s: ~F.exists("__b", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn("__b", base).select(*keep, F.sort_array(F.concat(F.col("__b"), clear)).alias("spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) from (hash, owner, repository) rows.

    Distinct first, by hash, owner and repository; then counts, summed on the
    map side for each hash, so a value that a third of all rows hold is no group of its own.
    """
    each = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: base counts and digest, all spans, ownership counts."""
    rows = pick(docs, id=id_col, owner=owner_col, repository=repository_col or id_col, text=text_col)
    found = scratch(scan(rows), "secret-spans")
    hashed = lambda s: F.sha2(s["value"], 256)
    exploded = found.filter(F.size("spans") > 0).select("owner", "repository", F.explode("spans").alias("s"))
    known = scratch(ownership(exploded.select(hashed(F.col("s")).alias("hash"), "owner", "repository")), "secret-owners")

    # few documents hold candidates; verdicts come back to them by row
    numbered = scratch(found.withColumn("row", F.monotonically_increasing_id()), "secret-rows")
    single = numbered.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).withColumn("hash", hashed(F.col("s")))
    judged = bounded_join(single.select("row", "s", "hash"), known, ["hash"])
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES)
    base = F.col("s.rank") < len(KINDS)
    judged = judged.filter(base | ~copied)
    piece = F.concat_ws(":", F.col("s.kind"), F.col("s.start"), F.col("s.end"))
    listed = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), piece.alias("p")))).alias("all"),
        *[F.count_if(F.col("s.rank") == k).alias(f"n_{kind}") for k, (kind, *_) in enumerate([*KINDS, OPAQUE])],
        F.count_if(base & copied).alias("n_copied"), F.count_if(base & ~copied).alias("n_owner_specific"),
    )
    out = numbered.drop("spans").join(listed, "row", "left")
    join = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: x["p"]), ","), F.lit(""))
    base_list = F.filter("all", lambda x: x["rank"] < len(KINDS))
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "live", "copied", "owner_specific")]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(join(base_list), 256).alias("base_sha256"), join(F.col("all")).alias("spans"))
