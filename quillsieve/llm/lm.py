"""Hashed maximum-entropy language model with class-factored softmax.

Words become units: the ``HEAD`` most frequent training words, the end token
among them, and ``TAIL`` hashed units for all other words.  A text's log10
probability is the sum over its tokens of

    log P(class | f1, f2, f12, w1) + log P(unit | class, g1, w1) + log P(word | unit)

where f1 and g1 are hashed features of the word before, f2 of the one before
that (a skip feature), f12 of both (an n-gram feature) and w1 is the word before
itself, hashed to 32 bits.  The class softmax has a weight for each feature and
class, the softmax within a class one for each feature and unit.  Weights of w1
exist for the pairs of neighbouring words that the training texts hold, so they
are as many as those; a hashed unit shares its probability among its words by
their smoothed counts, with one share for all unseen words.  Classes group
units by the words they follow.

Training.  The corpus is counted once: feature cells with their counts are a
table that grows with the corpus up to all cells, pairs of neighbouring words
one that grows without a bound.  Each round sends the weights of f1, f2
and f12 to the workers, every partition of the table returns its part of the
gradient, and the summed gradient updates the weights.  Those of g1 and w1 are
independent between features, so their rounds run where the cells are, the rounds of w1
with all other weights fixed; for the class softmax its expected counts
take f2 and f12 by their mean over the corpus.  The weights of w1 are sharded by w1
and never meet in one place.

Scoring works on batches: tokens go once to the shard of the word before, about
``SHARD`` tokens each, where the weights of w1 are fitted, and log probabilities gathered by sparse index
and summed for each text.  Words with ``SHARD`` tokens or more are counted and fitted before; their
tokens are dealt out over copies of their weights, ``UNITS`` each at most.

Word counts.  Words are counted by 64-bit hashes over all training texts.  The
most frequent ones, ``COUNTED`` at most, are sent to the workers; counts of all
other words are joined to the documents that hold them.

Defined results: a null or empty text is the end token alone; texts without an
id are training texts (crc32 of a null is null, taken as not 0); repeated rows
are scored each; without any training text all counts are zero and the scores
are uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, pick, scratch

HEAD = 16384  #: words that are units of their own
TAIL = 1024  #: hashed units
UNITS = HEAD + TAIL
CLASSES = 64
COUNTED = 1 << 18  #: words whose counts are sent to the workers
FEATURES = 128  #: values of f1 and of f2
NGRAMS = 512  #: values of f12
GROUPS = 32  #: values of g1
ROUNDS = 10
ALPHA = 0.1  #: added to counts
FOLDS = 10
SHARD = 1 << 20  #: tokens in a shard
HELD = 1 << 20  #: tokens that a task holds before it deals them out
TEXTS = 1 << 14  #: texts whose sums come back together; rows of one task are numbered from a multiple of it
PRIOR = (0.08, 0.15)  #: strengths of the normal priors on weights of w1, for units and for classes
WORD_ROUNDS = 16
SPREAD = 4_000_000  #: codes for each hashed unit
_BOS = UNITS  #: stands before a text
_START = (1 << 32) - 1  #: its code
_CELL = np.dtype([("ctx", "<u4"), ("unit", "<u2"), ("x", "<f4")])
_END = xxhash.xxh64_intdigest(b" ")  #: no word holds a space


def feature(units: np.ndarray, size: int) -> np.ndarray:
    """Hashed feature of unit ids: the most frequent have values of their own, the rest share."""
    own = size * 3 // 4
    shared = own + 1 + (units.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (size - own - 1)
    return np.where(units == _BOS, own, np.where(units < own, units, shared))


def ngram(f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    return ((f1 * FEATURES + f2).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % NGRAMS


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the lower-cased words and of the end token."""
    return np.frombuffer(b"".join([*map(xxhash.xxh64_digest, text.lower().split()), _END.to_bytes(8, "big")]), ">u8").astype(np.uint64)


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text").cast(pa.large_binary())]


def _distinct(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct 64-bit values with counts; a task's are merged up to a bounded number."""
    h, n, fresh, held = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every, first = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (np.empty(0, np.uint64), np.empty(0, np.int64))
        keys, at = np.unique(np.concatenate([h, every]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n, first]), len(keys)).astype(np.int64)

    for part in parts:
        fresh.append(part)
        held += len(part)
        if held > 1 << 21:
            h, n = merged()
            fresh, held = [], 0
            if len(h) > 1 << 22:
                yield h, n
                h, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    h, n = merged()
    if len(h):
        yield h, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h, n in _distinct(word_hashes(t) for b in batches for t in _texts(b)):
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def count_words(rows: DataFrame) -> DataFrame:
    """(h, n) over all training texts."""
    return scratch(rows.filter("not held_out").select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-counts")


def frequent(counts: DataFrame, most: int = COUNTED) -> tuple[np.ndarray, np.ndarray]:
    """All words from the least count that at most ``most`` words reach: sorted hashes and counts."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    steps = sorted(((r["level"], r["words"], r["least"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()), reverse=True)
    total, least = 0, None
    for _, words, low in steps:
        total += words
        if total > most:
            break
        least = low
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    got = counts.filter(F.col("n") >= least).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _tail_code(h: np.ndarray) -> np.ndarray:
    """Codes of words outside the head: their unit is the remainder by ``TAIL``."""
    return (np.uint64(HEAD) + np.uint64(TAIL) * ((h >> np.uint64(32)) % np.uint64(SPREAD)) + h % np.uint64(TAIL)).astype(np.int64)


def unit_of(code: np.ndarray) -> np.ndarray:
    return np.where(code < HEAD, code, np.where(code == _START, _BOS, HEAD + (code - HEAD) % TAIL))


def _encode(known: np.ndarray, n: np.ndarray, unit: np.ndarray, share: np.ndarray, log_norm: float):
    """Documents as word codes, with what counts of frequent words give and the words still to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        value = np.log10(n + ALPHA)
        inner = np.where(unit >= HEAD, value - share[np.maximum(unit - HEAD, 0)], 0.0)
        for b in batches:
            out = [[] for _ in range(8)]
            for t in _texts(b):
                h = word_hashes(t)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                own = np.where(hit, unit[at], HEAD + (h % np.uint64(TAIL)).astype(np.int64)) if len(known) else HEAD + (h % np.uint64(TAIL)).astype(np.int64)
                rest, k = np.unique(h[~hit], return_counts=True)
                inside = inner[at[hit]].sum() if len(known) else 0.0
                inside -= share[own[~hit] - HEAD].sum()
                for o, x in zip(out, (row, np.where(own < HEAD, own, _tail_code(h)).astype("<u4").tobytes(), len(h), int(hit.sum()), float((value[at[hit]].sum() if len(known) else 0.0) - log_norm * len(h)), float(inside), rest.view(np.int64), k), strict=True):
                    o.append(x)
                row += 1
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], ["id", "held_out", "row", "units", "n_tokens", "hits", "base", "inside", "rest", "times"])

    return run


def _contexts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens in a batch: unit, the unit before, the one before that, the code before; each text's first token."""
    parts = [np.frombuffer(x.as_buffer().to_pybytes(), "<u4") for x in b.column("units")]
    code = np.concatenate(parts).astype(np.int64)
    u = unit_of(code)
    first = np.cumsum([0, *[len(x) for x in parts]])[:-1]
    one, two, before = np.r_[_BOS, u[:-1]], np.r_[_BOS, _BOS, u[:-2]][: len(u)], np.r_[_START, code[:-1]]
    one[first] = _BOS
    two[first] = _BOS
    before[first] = _START
    late = first + 1
    two[late[late < len(u)]] = _BOS
    return u, one, two, before, first


def _cells(size: int, key):
    """Counts of the cells that ``key`` names, one row for each cell and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                u, one, two, _, _ = _contexts(b)
                total += np.bincount(key(u, one, two), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return run


def classes_of(cells: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Classes of units by spherical k-means on what they follow (UNITS x GROUPS counts)."""
    x = np.sqrt(cells.astype(np.float32) + 0.01)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight = np.sqrt(cells.sum(axis=1, dtype=np.float64) + 1e-3)
    centre = x[np.linspace(0, HEAD // 4, CLASSES).astype(int)]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        for c in range(CLASSES):
            if (own == c).any():
                centre[c] = (x[own == c] * weight[own == c, None]).sum(axis=0)
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    return own.astype(np.int64)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def class_logits(w: dict[str, np.ndarray], f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    return w["bias"] + w["one"][f1] + w["two"][f2] + w["both"][ngram(f1, f2)]


def _gradient(w: dict[str, np.ndarray]):
    """Observed and expected counts by feature and class over a partition's cells."""
    sizes = {"one": FEATURES, "two": FEATURES, "both": NGRAMS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: np.zeros((n, CLASSES)) for k, n in sizes.items()}
        model = {k: np.zeros((n, CLASSES)) for k, n in sizes.items()}
        for b in batches:
            cell, n = b.column("cell").to_numpy(), b.column("n").to_numpy().astype(np.float64)
            ctx, c = cell // CLASSES, cell % CLASSES
            every, at = np.unique(ctx, return_inverse=True)
            total = np.bincount(at, n, len(every))
            f1, f2 = every // FEATURES, every % FEATURES
            expected = np.exp(_log_softmax(class_logits(w, f1, f2))) * total[:, None]
            for k, f in (("one", f1), ("two", f2), ("both", ngram(f1, f2))):
                np.add.at(seen[k], (f[at], c), n)
                np.add.at(model[k], f, expected)
        for kind, k in enumerate(sizes):
            at = np.flatnonzero(seen[k] + model[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(seen[k].reshape(-1)[at]), pa.array(model[k].reshape(-1)[at])], ["kind", "at", "seen", "model"])

    return run


def train_classes(cells: DataFrame, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights of the class softmax by distributed gradient updates over the cell table.

    The gradient of a weight is its observed less its expected count; each is
    scaled by the greater of both, a diagonal estimate of its curvature.
    """
    sizes = {"one": FEATURES, "two": FEATURES, "both": NGRAMS}
    w = {k: np.zeros((n, CLASSES)) for k, n in sizes.items()}
    bias = np.full(CLASSES, 1.0)
    got = cells.groupBy((F.col("cell") % CLASSES).alias("c")).agg(F.sum("n").alias("n")).toArrow()
    bias[got.column("c").to_numpy()] += got.column("n").to_numpy()
    w["bias"] = np.log(bias / bias.sum())
    for step in range(rounds):
        got = cells.mapInArrow(_gradient(w), "kind int, at long, seen double, model double").groupBy("kind", "at").agg(F.sum("seen").alias("seen"), F.sum("model").alias("model")).toArrow()
        kind, at, seen, model = (got.column(c).to_numpy() for c in ("kind", "at", "seen", "model"))
        rate = 1.0 if step < 3 else 0.7
        for k, name in enumerate(sizes):
            mine = kind == k
            flat = w[name].reshape(-1)
            gain = (seen[mine] - model[mine] - 0.02 * flat[at[mine]]) / (np.maximum(seen[mine], model[mine]) + 5.0)
            flat[at[mine]] += rate * gain
    return w


def _within(classes: np.ndarray, bias: np.ndarray, rounds: int = 12):
    """Weights within classes for each value of g1, by gradient rounds over its own cells."""
    order = np.argsort(classes, kind="stable")
    edge = np.searchsorted(classes[order], np.arange(CLASSES + 1))
    filled = edge[1:] > edge[:-1]

    def log_p(x: np.ndarray) -> np.ndarray:
        z = (bias + x)[order]
        out = np.empty_like(z)
        for a, e in zip(edge, edge[1:], strict=False):
            if e > a:
                out[a:e] = _log_softmax(z[a:e])
        back = np.empty_like(out)
        back[order] = out
        return back

    def fit(n: np.ndarray) -> np.ndarray:
        x = np.zeros(UNITS)
        total = np.bincount(classes, n, CLASSES)[classes]
        for _ in range(rounds):
            model = total * np.exp(log_p(x))
            x += (n - model - 2.0 * x) / (np.maximum(n, model) + 4.0)
        return log_p(x)

    assert filled.any()
    return fit, log_p


def train_units(cells: DataFrame, classes: np.ndarray, unit_counts: np.ndarray) -> np.ndarray:
    """log P(unit | class, g1) as a table GROUPS x UNITS; each group's gradient rounds run on one worker."""
    bias = np.log(unit_counts + ALPHA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            cell, n = b.column("cell").to_numpy(), b.column("n").to_numpy()
            for g in np.unique(cell // UNITS):
                mine = cell // UNITS == g
                held.setdefault(int(g), np.zeros(UNITS))[cell[mine] % UNITS] += n[mine]
        fit, _ = _within(classes, bias)
        for g, n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([fit(n).astype("<f4").tobytes()])], ["g", "table"])

    _, log_p = _within(classes, bias)
    out = np.tile(log_p(np.zeros(UNITS)).astype(np.float32), (GROUPS, 1))
    spread = cells.repartition(F.floor(F.col("cell") / UNITS))
    for r in spread.mapInArrow(run, "g long, table binary").collect():  # GROUPS rows of one size
        out[r["g"]] = np.frombuffer(r["table"], "<f4")
    return out


def _pairs(hot: np.ndarray):
    """(ctx, unit, n): units with the code before, where that is frequent; one row for each pair and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for b in batches:
                if b.num_rows:
                    u, _, _, before, _ = _contexts(b)
                    mine = np.isin(before, hot)
                    yield (before[mine] << 15 | u[mine]).view(np.uint64)

        for key, n in _distinct(keys()):
            key = key.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 15), pa.array(key & 32767), pa.array(n)], ["ctx", "unit", "n"])

    return run


def fit_words(n: np.ndarray, base: np.ndarray, group: np.ndarray, prior: float, rounds: int = WORD_ROUNDS) -> np.ndarray:
    """Weights x, by gradient rounds, of outcomes with counts ``n`` whose probability is base * exp(x) / z in their group.

    Outcomes without a count keep ``base``, which sums to 1 with theirs.
    """
    total = np.bincount(group, n)[group]
    rest = np.maximum(1.0 - np.bincount(group, base), 0.0)
    x = np.zeros(len(n))
    for _ in range(rounds):
        p = base * np.exp(x)
        model = total * p / (rest + np.bincount(group, p))[group]
        x += (n - model - prior * x) / (np.maximum(n, model) + prior)
    return x


def fit_shard(ctx: np.ndarray, u: np.ndarray, n: np.ndarray, within: np.ndarray, classes: np.ndarray, mean: np.ndarray, prior: tuple[float, float]) -> np.ndarray:
    """Weights of w1, for units and for classes, from counts of distinct pairs."""
    every, k = np.unique(ctx, return_inverse=True)
    one = unit_of(every)
    group, at = np.unique(k * CLASSES + classes[u], return_inverse=True)
    x = fit_words(n, np.exp(within[feature(one, GROUPS)[k], u].astype(np.float64)), at, prior[0])
    row, c = group // CLASSES, group % CLASSES
    y = fit_words(np.bincount(at, n), mean[feature(one, FEATURES)[row], c], row, prior[1])
    cells = np.empty(len(x) + len(y), _CELL)
    cells["ctx"], cells["unit"], cells["x"] = np.r_[ctx, every[row]], np.r_[u, UNITS + c], np.r_[x, y]
    return cells


class Deal:
    """Where tokens go: to the shard of the code before, or to one of the copies of a frequent code.

    ``codes`` have ``SHARD`` tokens or more each, ``counts`` are theirs.
    """

    def __init__(self, tokens: int, codes: np.ndarray, counts: np.ndarray, size: int):
        self.shards = max(8, tokens // size)
        self.codes, at = np.unique(codes, return_inverse=True)
        counts = np.bincount(at, counts, len(self.codes)).astype(np.int64)
        hot = counts >= size
        self.codes = self.codes[hot]
        self.copies = -(-counts[hot] // size)
        self.first = self.shards + np.cumsum(self.copies) - self.copies
        self.keys = self.shards + int(self.copies.sum())

    def of(self, ctx: np.ndarray) -> np.ndarray:
        key = ctx % self.shards
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, ctx), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[at] == ctx)
            key[hit] = self.first[at[hit]] + hit % self.copies[at[hit]]
        return key


def _weights(deal: Deal, within: np.ndarray, classes: np.ndarray, mean: np.ndarray, prior: tuple[float, float]):
    """Packed weights of frequent codes for each of their copies, from (ctx, unit, n) sorted by ctx, ``UNITS`` rows each at most."""

    def fit(ctx: int, held: list) -> Iterator[pa.RecordBatch]:
        u, n = map(np.concatenate, zip(*held, strict=True))
        cells = fit_shard(np.full(len(u), ctx), u, n, within, classes, mean, prior).tobytes()
        at = int(np.searchsorted(deal.codes, ctx))
        for i in range(deal.copies[at]):
            yield _dealt([deal.first[at] + i], cells=[cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            ctx, u, n = (b.column(c).to_numpy() for c in ("ctx", "unit", "n"))
            edge = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else []
            for a, e in zip(edge, [*edge[1:], len(ctx)], strict=True):
                if ctx[a] != now and held:
                    yield from fit(now, held)
                    held = []
                now = int(ctx[a])
                held.append((u[a:e], n[a:e]))
        if held:
            yield from fit(now, held)

    return run


_DEALT = "key long, cells binary, rows binary, sizes binary, ctx binary, two binary, unit binary"


def _dealt(key: list[int], **have: list[bytes]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _DEALT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *[pa.array(have.get(c, [None] * len(key)), pa.binary()) for c in names[1:]]], names)


def _deal(deal: Deal):
    """Tokens by key: rows of the texts with the number of tokens that each has there (twice, and one more if held out), and the tokens."""

    def flush(row, held_out, ctx, two, unit) -> Iterator[pa.RecordBatch]:
        row, held_out, ctx, two, unit = map(np.concatenate, (row, held_out, ctx, two, unit))
        key = deal.of(ctx)
        order = np.argsort(key, kind="stable")
        row, held_out, ctx, two, unit, key = (x[order] for x in (row, held_out, ctx, two, unit, key))
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for a, e in zip(edge, np.r_[edge[1:], len(key)], strict=True):
            texts = np.flatnonzero(np.r_[True, row[a + 1 : e] != row[a : e - 1]])
            sizes = np.diff(np.r_[texts, e - a]) * 2 + held_out[a:e][texts]
            yield _dealt([key[a]], rows=[row[a:e][texts].astype("<i8").tobytes()], sizes=[sizes.astype("<u4").tobytes()], ctx=[ctx[a:e].astype("<u4").tobytes()], two=[two[a:e].astype("u1").tobytes()], unit=[unit[a:e].astype("<u2").tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                u, _, two, before, first = _contexts(b)
                many = np.diff(np.r_[first, len(u)])
                row, out = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), many) for c in ("row", "held_out"))
                for i in range(0, len(u), HELD):
                    z = slice(i, i + HELD)
                    held.append((row[z], out[z], before[z], feature(two[z], FEATURES).astype(np.uint8), u[z].astype(np.uint16)))
                    size += len(held[-1][0])
                    if size >= HELD:
                        yield from flush(*zip(*held, strict=True))
                        held, size = [], 0
        if size:
            yield from flush(*zip(*held, strict=True))

    return run


class Shard:
    """Weights of w1 for the words of a shard, with the normalizers within classes."""

    def __init__(self, cells: np.ndarray, within: np.ndarray, classes: np.ndarray):
        ctx, unit, x = cells["ctx"].astype(np.int64), cells["unit"].astype(np.int64), cells["x"].astype(np.float64)
        self.ctx, k = np.unique(ctx, return_inverse=True)
        self.outer = np.zeros((len(self.ctx) + 1, CLASSES), np.float32)  # the last row is that of words without weights
        c = unit >= UNITS
        self.outer[k[c], unit[c] - UNITS] = x[c]
        k, unit, x = k[~c], unit[~c], x[~c]
        p = np.exp(within[feature(unit_of(self.ctx), GROUPS)[k], unit].astype(np.float64))
        z = np.bincount(k * CLASSES + classes[unit], p * np.expm1(x), len(self.outer) * CLASSES)
        self.inner = np.log1p(z).astype(np.float32).reshape(-1, CLASSES)
        self.pair = k * UNITS + unit
        order = np.argsort(self.pair)
        self.pair, self.x = np.r_[self.pair[order], np.int64(1) << 62], np.r_[x[order], 0.0]

    def find(self, ctx: np.ndarray) -> np.ndarray:
        none = len(self.ctx)
        at = np.searchsorted(self.ctx, ctx)
        return np.where(self.ctx[np.minimum(at, none - 1)] == ctx, at, none) if none else np.zeros(len(ctx), np.int64)

    def weight(self, k: np.ndarray, unit: np.ndarray) -> np.ndarray:
        pair = k * UNITS + unit
        at = np.searchsorted(self.pair, pair)
        return np.where(self.pair[at] == pair, self.x[at], 0.0)


def log_p(shard: Shard, table: np.ndarray, within: np.ndarray, classes: np.ndarray, ctx: np.ndarray, two: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """log P(class) + log P(unit | class) of tokens after codes ``ctx`` and skip features ``two``."""
    k, one, c = shard.find(ctx), unit_of(ctx), classes[unit]
    z = table[feature(one, FEATURES), two] + shard.outer[k]
    at = np.arange(len(unit))
    got = (z[at, c] - np.log(np.exp(z).sum(axis=1))).astype(np.float64)
    return got + within[feature(one, GROUPS), unit] + shard.weight(k, unit) - shard.inner[k, c]


def _score(table: np.ndarray, within: np.ndarray, classes: np.ndarray, mean: np.ndarray, prior: tuple[float, float]):
    """Sums of log10 P(class) and log10 P(unit) over the tokens that texts have in a shard.

    The weights of a shard are fitted on its training tokens, those of a copy of a frequent code have come with it.
    """
    kinds = {"rows": "<i8", "sizes": "<u4", "ctx": "<u4", "two": "u1", "unit": "<u2"}

    def judge(cells: list[np.ndarray], chunks: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not cells:
            learn = [(ctx.astype(np.int64) << 15 | unit)[np.repeat(sizes % 2 == 0, sizes // 2)] for _, sizes, ctx, _, unit in chunks]
            pair, n = np.unique(np.concatenate(learn), return_counts=True)
            del learn
            cells = [fit_shard(pair >> 15, pair & 32767, n, within, classes, mean, prior)]
        shard = Shard(np.concatenate(cells), within, classes)
        got = []
        for rows, sizes, ctx, two, unit in chunks:
            total = np.empty(len(ctx))
            for i in range(0, len(ctx), 1 << 15):
                z = slice(i, i + (1 << 15))
                total[z] = log_p(shard, table, within, classes, ctx[z].astype(np.int64), two[z], unit[z].astype(np.int64))
            first = np.cumsum(np.r_[0, sizes.astype(np.int64) // 2])[:-1]
            got.append((rows, np.add.reduceat(total, first) / math.log(10)))
        rows, at = np.unique(np.concatenate([r for r, _ in got]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([x for _, x in got]), len(rows))
        edge = np.flatnonzero(np.r_[True, rows[1:] // TEXTS != rows[:-1] // TEXTS])
        ranges = list(zip(edge, np.r_[edge[1:], len(rows)], strict=True))
        packed = [[(rows[a:e] % TEXTS).astype("<u4").tobytes() for a, e in ranges], [sums[a:e].astype("<f8").tobytes() for a, e in ranges]]
        yield pa.RecordBatch.from_arrays([pa.array(rows[edge] // TEXTS), *[pa.array(x, pa.binary()) for x in packed]], ["range", "at", "outer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, chunks = None, [], []
        for b in batches:
            for i, key in enumerate(b.column("key").to_pylist()):
                if key != now and chunks:
                    yield from judge(cells, chunks)
                if key != now:
                    now, cells, chunks = key, [], []
                packed = b.column("cells")[i]
                if packed.is_valid:
                    cells.append(np.frombuffer(packed.as_buffer(), _CELL).copy())
                else:
                    chunks.append(tuple(np.frombuffer(b.column(c)[i].as_buffer(), kind).copy() for c, kind in kinds.items()))
        if chunks:
            yield from judge(cells, chunks)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, outer) from sums of ``TEXTS`` rows each, sorted by range."""
    now, total, seen = None, np.zeros(TEXTS), np.zeros(TEXTS, bool)

    def out() -> pa.RecordBatch:
        at = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(now * TEXTS + at), pa.array(total[at])], ["row", "outer"])

    for b in batches:
        for key, at, sums in zip(b.column("range").to_pylist(), b.column("at"), b.column("outer"), strict=True):
            if key != now:
                if now is not None:
                    yield out()
                now, total[:], seen[:] = key, 0.0, False
            at = np.frombuffer(at.as_buffer(), "<u4")
            total[at] += np.frombuffer(sums.as_buffer(), "<f8")
            seen[at] = True
    if now is not None:
        yield out()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Training texts are those whose crc32 of the id, written as text, is not a
    multiple of ``FOLDS``.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    rows = pick(docs, id=id_col, text=text_col).withColumn("held_out", held)
    kind = rows.schema["id"].dataType.simpleString()
    counts = count_words(rows)
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    log_norm = math.log10(tokens + ALPHA * (distinct + 1))

    known, n = frequent(counts)
    top = np.lexsort((known, -n))[:HEAD]
    unit = HEAD + (known % np.uint64(TAIL)).astype(np.int64)
    unit[top] = np.arange(len(top))
    # hashed units: tokens and words of each, over all words outside the head
    slot = F.pmod(F.col("h"), F.lit(TAIL)).alias("slot")  # TAIL divides 2^64
    got = counts.groupBy(slot).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow()
    tail_n, tail_words = np.zeros(TAIL), np.zeros(TAIL)
    tail_n[got.column("slot").to_numpy()], tail_words[got.column("slot").to_numpy()] = got.column("n").to_numpy(), got.column("words").to_numpy()
    own = (known[top] % np.uint64(TAIL)).astype(np.int64)
    tail_n -= np.bincount(own, n[top], TAIL)
    tail_words -= np.bincount(own, minlength=TAIL)
    share = np.log10(tail_n + ALPHA * (tail_words + 1))
    unit_counts = np.r_[n[top], np.zeros(HEAD - len(top)), tail_n + ALPHA * (tail_words + 1)]

    schema = f"id {kind}, held_out boolean, row long, units binary, n_tokens long, hits long, base double, inside double, rest array<long>, times array<long>"
    encoded = scratch(rows.mapInArrow(_encode(known, n, unit, share, log_norm), schema), "lm-units")
    train = encoded.filter("not held_out").select("units")

    table = lambda size, key, name: scratch(train.mapInArrow(_cells(size, key), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), name)
    follows = table(GROUPS * UNITS, lambda u, one, two: feature(one, GROUPS) * UNITS + u, "lm-follows")
    got = follows.toArrow()  # GROUPS x UNITS cells at most
    flat = np.zeros(GROUPS * UNITS, np.int64)
    flat[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    classes = classes_of(flat.reshape(GROUPS, UNITS).T)
    within = train_units(follows, classes, unit_counts)
    cells = table(FEATURES * FEATURES * CLASSES, lambda u, one, two: (feature(one, FEATURES) * FEATURES + feature(two, FEATURES)) * CLASSES + classes[u], "lm-cells")
    w = train_classes(cells)
    f = np.arange(FEATURES * FEATURES)
    log_class = _log_softmax(class_logits(w, f // FEATURES, f % FEATURES)).astype(np.float32).reshape(FEATURES, FEATURES, CLASSES)

    got = cells.groupBy(F.floor(F.col("cell") / CLASSES).alias("f")).agg(F.sum("n").alias("n")).toArrow()  # FEATURES x FEATURES rows at most
    share = np.full(FEATURES * FEATURES, 1e-3)
    share[got.column("f").to_numpy()] += got.column("n").to_numpy()
    mean = np.einsum("ab,abc->ac", share.reshape(FEATURES, FEATURES), np.exp(log_class.astype(np.float64))) / share.reshape(FEATURES, FEATURES).sum(axis=1)[:, None]

    codes = np.where(unit < HEAD, unit, _tail_code(known))
    codes[known == _END] = _START  # as many texts start as end
    deal = Deal(int(tokens), codes, n, SHARD)
    tasks = max(deal.keys, spark.sparkContext.defaultParallelism)
    dealt = encoded.select("row", "held_out", "units").mapInArrow(_deal(deal), _DEALT)
    if len(deal.codes):
        pairs = train.mapInArrow(_pairs(deal.codes), "ctx long, unit long, n long").repartition("ctx").groupBy("ctx", "unit").agg(F.sum("n").alias("n")).sortWithinPartitions("ctx")
        dealt = dealt.unionByName(pairs.mapInArrow(_weights(deal, within, classes, mean, PRIOR), _DEALT))
    dealt = dealt.repartition(tasks, "key").sortWithinPartitions("key", F.col("cells").isNull())
    sums = dealt.mapInArrow(_score(log_class, within, classes, mean, PRIOR), "range long, at binary, outer binary")
    sums = sums.repartition("range").sortWithinPartitions("range").mapInArrow(_add_up, "row long, outer double")
    part = encoded.drop("units", "rest", "times").join(sums, "row")
    rest = encoded.filter(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.times").alias("k"))
    joined = rest.join(counts, "h", "left")
    c = F.coalesce("n", F.lit(0))
    added = joined.groupBy("row").agg(F.sum(F.col("k") * F.log10(c + F.lit(ALPHA))).alias("logs"), F.sum(F.when(c > 0, F.col("k")).otherwise(F.lit(0))).alias("more"))
    out = part.join(added, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("outer") + F.col("inside") + logs).alias("score"))
