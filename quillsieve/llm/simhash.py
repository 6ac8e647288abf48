"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits are cut into fewer segments than the usual distance
plus one: with distance 2 into two halves, one of which then differs by at most
one bit.  Each half is indexed under its 32 one-wildcard variants (the variant
names the bit it ignores), equality on a variant finds the candidates, and the
full distance is verified.

Hot variants.  Rows of a variant are scanned in sorted order in bounded windows.
A variant with more rows than ``RUN`` is not compared pair by pair: its rows
are dealt out again under exact signatures, that is all ways to ignore the bits
that may still differ in the other half.  Rows with one exact signature are
within the distance by construction, so a star of links joins them; no link is
lost and no pair list is quadratic.

Defined results: a null or wordless text has fingerprint zero and links like any
other; equal fingerprints are one node; null ids never name a component unless
the whole component has none; repeated rows get equal results; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup
from .common import BROADCAST_BYTES, bound_arrow, discard, merged_if_large, pick, scratch, sieved, skew_join

SEED = 42
DISTANCE = 2
RUN = 64  #: rows of one variant that are compared pair by pair
_ONE = np.uint64(1)
_HALF = np.uint64(0xFFFFFFFF)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)  # a byte holds a sum of 255 bits
    counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def simhash(text: bytes, width: int = 3) -> int:
    """Fingerprint of a UTF-8 text: shingles of ``width`` words, A-Z lower-cased, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) < width:
        got = [h(b" ".join(w), SEED)]
    else:
        got = [h(b" ".join(t), SEED) for t in zip(*[w[i:] for i in range(width)], strict=False)]
    return majority(np.array(got, np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""
    bound_arrow(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [simhash(x.as_buffer().to_pybytes(), width) if x.is_valid else 0 for x in b.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(got, np.uint64).view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-wildcard variants of both halves: keys of shape (n, 64).

    Bit b's variant of the half that holds it: that half with bit b cleared,
    moved to the low 32 bits, with b in the bits above.
    """
    b = np.arange(64, dtype=np.uint64)
    cleared = fps[:, None] & ~(_ONE << b)
    half = np.where(b < 32, cleared & _HALF, cleared >> np.uint64(32))
    return half | (b << np.uint64(32)), np.repeat(fps, 64)


def exact_signatures(key: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Finer keys for rows of a hot variant; rows with an equal one are within the distance.

    Rows whose own halves are equal meet in the half's first variant as well, so
    only there up to two bits of the other half are ignored; rows that differ in
    the ignored bit may differ in one other.
    """
    bit = key >> np.uint64(32)
    other = np.where(bit < 32, np.uint64(32), np.uint64(0))
    keys, rows = [], []
    first = bit % np.uint64(32) == 0
    for ignored, own in ((distance, False), (distance - 1, True)):
        part = slice(None) if own else first
        rest, at, far = fps[part], bit[part], other[part]
        for bits in combinations(range(32), ignored):
            mask = np.zeros(len(rest), np.uint64)
            name = np.uint64(1 + own)
            for x in bits:
                mask |= _ONE << (np.uint64(x) + far)
                name = name * np.uint64(67) + np.uint64(x + 1)
            if own:
                mask |= _ONE << at
            keys.append(np.stack([rest & ~mask, name + np.uint64(1_000_003) * at], axis=1))
            rows.append(rest)
    return np.concatenate(keys), np.concatenate(rows)


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for a in range(0, len(fps), 4096):
            k, f = variants(fps[a : a + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(f.view(np.int64))], ["key", "fp"])


def _links(most: int):
    """Verified links of sorted (key, fp) rows; rows of keys with over ``most`` rows go out with the key instead.

    Out: (key, a, b); key null: a link of two fingerprints; else b is null and a is
    a fingerprint of that hot key.  A run that crosses batches is carried over, ``most`` rows of it at most.
    """

    def emit(keys: np.ndarray, fps: np.ndarray, hot: np.uint64 | None) -> pa.RecordBatch | None:
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[edge, len(keys)])
        run = np.repeat(np.arange(len(edge)), size)
        warm = (size > most)[run]
        if hot is not None and len(keys):
            warm |= keys == hot
        a, b = [], []
        cool = ~warm
        for step in range(1, min(most, int(size.max(initial=1)))):
            i = np.flatnonzero((run[step:] == run[:-step]) & cool[step:])
            if not len(i):
                break
            near = np.bitwise_count(fps[i] ^ fps[i + step]) <= DISTANCE
            a.append(fps[i][near])
            b.append(fps[i + step][near])
        a, b = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b))
        hk, hf = keys[warm].view(np.int64), fps[warm].view(np.int64)
        if not len(a) + len(hk):
            return None
        key = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(hk)])
        other = pa.concat_arrays([pa.array(b), pa.nulls(len(hk), pa.int64())])
        return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([a, hf])), other], ["key", "a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, hot = np.empty(0, np.uint64), np.empty(0, np.uint64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))
            open_hot = len(keys) - last > most or keys[-1] == hot
            cut = len(keys) if open_hot else last
            if cut and (out := emit(keys[:cut], fps[:cut], hot)) is not None:
                yield out
            hot = keys[-1] if open_hot else None
            keys, fps = keys[cut:], fps[cut:]
        if len(keys) and (out := emit(keys, fps, hot)) is not None:
            yield out

    return scan


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, fps = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "a"))
        for a in range(0, len(fps), 256):
            k, f = exact_signatures(key[a : a + 256], fps[a : a + 256])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(k[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(k[:, 1]).view(np.int64)), pa.array(f.view(np.int64))], ["k1", "k2", "fp"])


def near_links(fps: DataFrame, most: int = RUN) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within the distance of each other.

    Every variant with few rows yields all its verified pairs; a hot one a star
    for each exact signature.  The links' components are those of all pairs.
    """
    bound_arrow(fps.sparkSession)
    rows = fps.select("fp").distinct().mapInArrow(_variant_rows, "key long, fp long")
    found = scratch(rows.repartition(F.col("key")).sortWithinPartitions("key", "fp").mapInArrow(_links(most), "key long, a long, b long").distinct(), "simhash-links")
    cool = found.filter(F.col("key").isNull()).select("a", "b")
    fine = found.filter(F.col("key").isNotNull()).mapInArrow(_signature_rows, "k1 long, k2 long, fp long")
    star = fine.groupBy("k1", "k2").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
    star = star.filter("a < z")
    # a signature's rows all link to its least fingerprint
    links = fine.join(star.select("k1", "k2", "a").hint("merge"), ["k1", "k2"]).filter("fp > a").select("a", F.col("fp").alias("b"))
    out = scratch(cool.unionByName(links).distinct(), "simhash-pairs")
    discard(found)
    return out


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, label): the least node (as a signed long) of each linked node's component, that one left out.

    Alternates large-star and small-star steps, each a shuffle by node, until the
    links no longer change; every round's links are a written table, and no side
    of its joins is broadcast unless their number is small.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").distinct()

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first())

    # b > a throughout
    now = scratch(tidy(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "cc")
    seen = signature(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: a node's greater neighbours link to the least of its neighbourhood
        large = tidy(now.join(merged_if_large(low, seen[0], BROADCAST_BYTES), "a").select(F.col("m").alias("a"), "b"))
        # small star: a node and its lesser neighbours link to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(merged_if_large(least, seen[0], BROADCAST_BYTES), "b").select("b", "a", "m")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        last, now = now, scratch(tidy(small), "cc")
        discard(last)
        after = signature(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component_id): the least id that links reach from each document."""
    fps = scratch(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = scratch(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    links = near_links(nodes)
    label = components(links)
    label = merged_if_large(label, limit=BROADCAST_BYTES)
    named = nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    # a component's least id; labels are few rows each after the fingerprints were made distinct
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    answer = scratch(named.join(least.hint("merge"), "label").select("fp", "component_id"), "simhash-answer")
    discard(nodes, links)
    # the answer grows with the documents: rows of equal fingerprints meet it by key, hot ones by salts
    return skew_join(fps, merged_if_large(answer, limit=BROADCAST_BYTES // 8), ["fp"]).select("id", "fp", "component_id")


def _least_by_fingerprint(rows: DataFrame, width: int) -> DataFrame:
    """(id, th, n): of each group of near fingerprints the least row, and how many rows it is."""
    key = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    found = near_duplicates(rows.select(key.alias("doc_id"), "text"), width=width)
    keep = found.filter(F.col("id") == F.col("component_id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return keep.select("id.id", "id.th", "n")


def verified_links(join: linededup.Join, width: int) -> DataFrame:
    """(x, y) classes of shingle sets whose fingerprints link and whose sets have a Jaccard similarity of 0.8, a scratch table."""
    doc = F.xxhash64("id", "th").alias("doc")
    fps = scratch(fingerprints(join.rows.select(doc, "text"), "doc", "text", width), "simhash")
    first = fps.groupBy("id").agg(F.min("fp").alias("fp")).withColumnRenamed("id", "doc")
    mine = join.classes.select("rank", F.xxhash64("first.id", "first.th").alias("doc"))
    named = scratch(mine.join(first, "doc").select("rank", "fp"), "simhash-classes")
    nodes = scratch(named.groupBy("fp").agg(F.min("rank").alias("least")), "simhash-nodes")
    links = near_links(nodes)
    side = lambda c: merged_if_large(nodes, limit=BROADCAST_BYTES).select(F.col("fp").alias(c), F.col("least").alias(f"{c}_rank"))
    far = links.join(side("a"), "a").join(side("b"), "b").select(F.greatest("a_rank", "b_rank").alias("x"), F.least("a_rank", "b_rank").alias("y"))
    same = skew_join(named, merged_if_large(nodes, limit=BROADCAST_BYTES), ["fp"]).filter("rank > least").select(F.col("rank").alias("x"), F.col("least").alias("y"))
    pairs = scratch(far.unionByName(same).distinct(), "simhash-candidates")
    likely = join.likely(pairs)
    out = join.verified(likely)
    discard(fps, named, nodes, links, pairs, likely)
    return out


def _least_by_shingles(rows: DataFrame, width: int) -> DataFrame:
    """As ``_least_by_fingerprint``, for groups linked by a Jaccard similarity of 0.8 of shingle sets.

    Fingerprints link first, and their links are verified on the sets.  At that
    similarity they differ in about ten places of 64, where no segment of them tells
    pairs apart, so an exact join of sets follows for what they leave apart.
    """
    join = linededup.Join(rows, partial(linededup.shingles, width=width))
    known = verified_links(join, width)
    label = join.components(components, known)
    discard(known)
    named = join.classes.select("rank", "first").join(label, F.col("rank") == F.col("node"), "left").select("first", F.coalesce("label", "rank").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.id").alias("k_id"), F.col("first.th").alias("k_th"))
    # rows of one key, combined in each task
    n = join.lines.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"))
    out = scratch(n.join(least, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")), "left_semi"), "simhash-least")
    discard(label)
    join.drop()
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, exact: bool = False) -> DataFrame:
    """The documents with one of each group: the row with the group's least id, once.

    Groups are linked by fingerprints, or with ``exact`` by a Jaccard similarity
    of 0.8 or more of the shingle sets.

    Rows are told apart by id and text; of rows that agree in both, one stays.
    Rows without an id come last in their group, so a group of such rows alone
    keeps one.
    """
    names = docs.columns
    at, text = names.index(id_col), names.index(text_col)
    own = lambda df: df.withColumn("__th", F.xxhash64(F.coalesce(F.col(f"__d{text}"), F.lit(""))))
    inner = own(docs.toDF(*[f"__d{i}" for i in range(len(names))]))
    rows = inner.select(F.col(f"__d{at}").alias("id"), F.col(f"__d{text}").alias("text"), F.col("__th").alias("th"))
    keep = (_least_by_shingles if exact else _least_by_fingerprint)(rows, width)
    keep = merged_if_large(scratch(keep.toDF("__id", "__kh", "n"), "simhash-keep"), limit=BROADCAST_BYTES)
    same = F.col(f"__d{at}").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__kh"))
    # keys of rows that go or repeat; all others stay, and their texts need no shuffle
    open_ = scratch(inner.select(f"__d{at}", "__th").join(keep.filter("n = 1"), same, "left_anti").distinct(), "simhash-open")
    some, others = sieved(inner, F.xxhash64(f"__d{at}", "__th"), open_.select(F.xxhash64(f"__d{at}", "__th")))
    once = some.join(keep.filter("n = 1"), same, "left_semi").unionByName(others).select(*inner.columns[:-1])
    # rows that repeat: one for each key, combined in each task before they meet
    again = some.join(keep.filter("n > 1"), same, "left_semi")
    again = again.groupBy(f"__d{at}", "__th").agg(F.first(F.struct(*[f"__d{i}" for i in range(len(names))])).alias("r")).select("r.*")
    return once.unionByName(again).toDF(*names)
