"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, A-Z lower-cased.  Lines of at least
``least`` words (``MIN_TOKENS`` unless given; with 1, every line that has a
word) whose token sets have a Jaccard similarity of 0.8 or more
match; of matching lines the later ones are removed, in order of document id
and line number.  A line is removed if any earlier line matches it, whether or
not that one is removed as well.

The join.  Equal token sets are one class, numbered in order of its first line.
Tokens are ordered by rarity, taken from a table of fixed size that counts
hashed tokens over all documents (any common order gives exact results; rarity
only makes prefixes selective).  Each class is indexed under the tokens of its
prefix; pairs that share one pass the length and positional filters and a
comparison of 128 parities of hashed tokens, then one of 256, which differ in no more places than
the sets have tokens apart; sets of more than ``WIDE`` tokens then by as many parities as they have
tokens, where 256 would let any two pass.  What is left is verified on whole token sets.

One witness is enough for a later line, so no group of near copies is expanded
into its pairs.  A round emits for each class its ``most`` earliest candidates
in each run of a prefix token; they are verified, and the first that holds is
the class's earliest match.  Classes whose candidates all failed while a run had
more take the next round, with many times as many, until none is left.

Where a caller wants the number of all matching lines, candidates only say which
classes may belong together: each task gives a forest of its candidate pairs, whose
components are the groups.  A group's token sets meet in one place, or in one for
each two blocks of ``GROUP`` classes, where all pairs are compared and counted.
Every link counts, and no list of pairs is written.

A run with more than ``RUN_ROWS`` rows is dealt out in blocks of its classes,
each pair of blocks a run of its own.  Tokens and sets are compared by 64-bit
hashes, sets by two independent sums; runs are named by 32 bits, which only adds
candidates.

Defined results: a null text is empty; lines of fewer than ``least`` words stay; rows with
equal id and text are one document and get equal results, each counts as a line
that matches; rows without an id come last; two rows with one id and different
texts are ordered by a hash of the text; texts of any length are read whole, in
slices of bounded size; a document that loses every line with
a word is dropped by ``remove_lines``, one that had none stays; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bound_arrow, discard, pick, scratch, sieved, skew_join, value_bytes

MIN_TOKENS = 5  #: words of a line, where the caller gives no other number
#: Similarity as a fraction, so that bounds are exact.
NUM, DEN = 4, 5
COUNT_BITS = 16  #: of the rarity table
SIEVE_BITS = 23  #: of the bitmaps that tell which lines are needed again
RUN_BITS = 23  #: of the bitmap that tells which runs are
SKETCHES = 4  #: words of 64 parities, compared before whole token sets; a power of two
WIDE = 64 * SKETCHES  #: tokens from which a set has as many parities as tokens, or more
PAIRS = 1 << 20  #: pairs compared at once
BUCKET_ROWS = 1 << 20  #: index rows that a bucket of runs holds, about
RUN_ROWS = 1 << 20  #: index rows of one run from which it is dealt out in blocks
LONG_RUN = 4096  #: rows from which a run is searched from its earliest rows on
FIRST = 2  #: candidates of a class and run in the first round
BLOCK = 256  #: earliest rows of a long run that meet the others at once
LINES_AT_ONCE = 1 << 20
MEET = 1024  #: pairs with one y that are compared in one place
GROUP = 2048  #: classes of a group that are compared in one place
TOGETHER = 128  #: classes of small groups that are compared at once
SHARED = 2048  #: shared tokens of a group that are multiplied at once

#: A row of the index: run, class number, parities, tokens (top bits: all links are asked for; none are), place in the prefix.
ROW = np.dtype([("run", "<u4"), ("rank", "<i8"), ("parity", "<u8"), ("parity2", "<u8"), ("n", "<u4"), ("k", "<u4")])
#: With component labels and the class number up to which candidates are known.
LABELLED = np.dtype([*ROW.descr, ("label", "<i8"), ("floor", "<i8")])
_ASKED, _QUIET = np.uint32(1 << 31), np.uint32(1 << 30)
_SIZE = np.uint32((1 << 30) - 1)
_SKETCH = tuple(f"p{i}" for i in range(SKETCHES))


def _ceil_share(n: np.ndarray) -> np.ndarray:
    return -(-NUM * n // DEN)


def _need(both: np.ndarray) -> np.ndarray:
    """Overlap of a match of two sets that have ``both`` tokens together."""
    return -(-NUM * both // (NUM + DEN))


#: Of each byte: its part of a word's hash, A-Z as a-z, none for white space.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15  #: odd, so its powers can be undone modulo 2^64
_STEP = 0x5851F42D  #: odd; times a line's number it stays within 63 bits
PIECE = 1 << 16  #: bytes hashed at once, so that their sums stay in a core's cache


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x % (1 << 64), np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _pieces(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes that end behind white space; a longer word is whole."""
    a = 0
    while a < len(raw):
        z = min(len(raw), a + PIECE)
        if z < len(raw):
            back = np.flatnonzero(_SPACE[raw[max(a, z - 4096) : z]])
            if len(back):
                z = max(a, z - 4096) + int(back[-1]) + 1
            else:
                while z < len(raw) and not _SPACE[raw[z - 1]]:
                    more = np.flatnonzero(_SPACE[raw[z : z + PIECE]])
                    z = z + int(more[0]) + 1 if len(more) else min(len(raw), z + PIECE)
        yield a, z
        a = z


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased; where each begins in the joined texts; where lines end there.

    A word's hash is a polynomial of its bytes' values, so that sums over all bytes give all words at once.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    hashes, begins = [], []
    for a, z in _pieces(raw):
        part = raw[a:z]
        up, down = _powers(max(PIECE, 1 << (z - a - 1).bit_length()))
        total = np.cumsum(_VALUE[part] * up[: z - a])
        word = ~_SPACE[part]
        edge = np.diff(np.r_[False, word, False].view(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        before = np.where(begin > 0, total[begin - 1], np.uint64(0))
        hashes.append(_mix((total[end - 1] - before) * down[begin]))
        begins.append(begin + a)
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([none[0], *hashes]), np.concatenate([none[1], *begins]), np.flatnonzero(raw == 10)


def _distinct(h: np.ndarray, line: np.ndarray, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (line, hash) in order of line, rarity and the hash's low bits; ``line`` counts from 0 without gaps."""
    out = []
    cuts = np.searchsorted(line, np.arange(0, line[-1] + 1 if len(line) else 0, LINES_AT_ONCE))
    for a, z in zip(cuts, [*cuts[1:], len(h)], strict=True):
        x, own = h[a:z], line[a:z]
        key = (own - own[0]).astype(np.uint64) << np.uint64(44)
        if rarity is not None:
            key |= rarity[_slot(x)].astype(np.uint64) << np.uint64(32) | x & np.uint64(0xFFFFFFFF)
        else:
            key |= x & np.uint64((1 << 44) - 1)
        order = np.argsort(key)
        x, key, own = x[order], key[order], own[order]
        same = key[1:] == key[:-1]
        if (same & (x[1:] != x[:-1])).any():  # words that share all these bits
            order = np.lexsort((x, key))
            x, key, own = x[order], key[order], own[order]
        keep = np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1])]
        out.append((x[keep], own[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (h, line)


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tokenize(texts: list[bytes], least: int = MIN_TOKENS) -> Tokens:
    """Token hashes with repeats, their line in order from 0, and of each line its text's index and number."""
    h, begin, ends = word_hashes(texts)
    many = np.diff(np.r_[0, np.searchsorted(begin, ends)])
    good = many >= max(least, 1)
    if least > 1:
        h = h[np.repeat(good, many)]
    lines = np.flatnonzero(good)
    # a text's last line ends where the text does
    last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1)
    owner = np.searchsorted(last, lines)
    number = lines - np.r_[0, last[:-1] + 1][owner] if len(lines) else lines
    return h, np.repeat(np.arange(len(lines)), many[lines]), owner, number


def shingles(texts: list[bytes], width: int) -> Tokens:
    """As ``tokenize``, with each text as one line and its windows of ``width`` words as tokens.

    A text with fewer words is one window, one without a word an empty window.
    """
    h, begin, _ = word_hashes(texts)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
    many = np.bincount(text, minlength=len(texts))
    total = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        total = _mix(total * np.uint64(_BASE) + h[i : i + len(total)])
    inside = text[: len(total)] == text[width - 1 :][: len(total)]
    out, of = [total[inside]], [text[: len(total)][inside]]
    for t in np.flatnonzero(many < width):
        x = np.uint64(1 + many[t])
        a = int(np.searchsorted(text, t))
        for i in range(a, a + many[t]):
            x = _mix(np.array([x]) * np.uint64(_BASE) + h[i : i + 1])[0]
        out.append(np.array([x], np.uint64))
        of.append(np.array([t]))
    h, of = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return h[order], of[order], np.arange(len(texts)), np.zeros(len(texts), np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text").cast(pa.large_binary())]


def _small(b: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few bytes of text each, so that token arrays stay small."""
    at = 0
    held = 0
    sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist() if b.nbytes > size else []
    for i, n in enumerate(sizes):
        if held and held + n > size:
            yield b.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < b.num_rows:
        yield b.slice(at)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _count_tokens(split: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for whole in batches:
            for b in _small(whole):
                counts += np.bincount(_slot(split(_texts(b))[0]), minlength=1 << COUNT_BITS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    return run


def rarity_table(rows: DataFrame, split: Callable = tokenize) -> np.ndarray:
    """How frequent hashed tokens are over all lines, in 12 bits; its size is fixed by ``COUNT_BITS``."""
    out = np.zeros(1 << COUNT_BITS)
    got = rows.select("text").mapInArrow(_count_tokens(split), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return (np.log2(out + 1) * 64).astype(np.uint16)


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Binary values that hold so many elements of ``flat`` each."""
    ends = np.r_[0, np.cumsum(counts)] * flat.itemsize
    return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def _parities(h: np.ndarray, words: int, edge: np.ndarray) -> list[np.ndarray]:
    """For each set, a bit for each of 64 * ``words`` slots: whether it has an odd number of tokens there."""
    bit, word = np.uint64(1) << (h & np.uint64(63)), h >> np.uint64(6) & np.uint64(words - 1)
    return [np.bitwise_xor.reduceat(np.where(word == np.uint64(i), bit, np.uint64(0)), edge) for i in range(words)]


def _wide(h: np.ndarray, edge: np.ndarray, n: np.ndarray, least: int) -> pa.Array:
    """For each set of over ``least`` tokens its parities in the next power of two of slots, as bytes; else none."""
    bits = np.where(n > least, 1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64), 0)
    at = np.cumsum(bits) - bits
    own = np.repeat(bits > 0, n)
    slot = _mix(h[own] + np.uint64(_BASE)) & np.repeat(bits, n)[own].astype(np.uint64) - np.uint64(1)
    odd = np.bincount(np.repeat(at, n)[own] + slot.astype(np.int64), minlength=int(bits.sum())) & 1
    return _lists(np.packbits(odd.astype(np.uint8), bitorder="little"), bits // 8, pa.binary())


def _wide_fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y) whose wide parities, if both have them, leave a match possible."""
    for b in batches:
        left, right = ([np.frombuffer(v.as_buffer() or b"", "<u8") for v in b.column(c)] for c in ("x_wide", "y_wide"))
        both = sum(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x_n", "y_n"))
        allowed = both - 2 * _need(both)
        keep = np.ones(b.num_rows, bool)
        for i, (p, q) in enumerate(zip(left, right, strict=True)):
            if len(p) and len(q):
                # slots are low bits, so parities of fewer slots are those of more, folded
                k = min(len(p), len(q))
                odd = np.bitwise_xor.reduce(p.reshape(-1, k)) ^ np.bitwise_xor.reduce(q.reshape(-1, k))
                keep[i] = np.bitwise_count(odd).sum() <= allowed[i]
        yield b.select(["x", "y"]).filter(pa.array(keep))


def _line_rows(rarity: np.ndarray, split: Callable, sketched: bool):
    """For each line: document, number, set hashes, size, and the prefix's runs in order of rarity; ``sketched``: with more parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _small(whole):
                h, line, owner, number = split(_texts(b))
                if not len(h):
                    continue
                h, line = _distinct(h, line, rarity)
                edge = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                n = np.diff(np.r_[edge, len(h)])
                s1, s2 = np.add.reduceat(h, edge), np.add.reduceat(_mix(h), edge)
                odd = _parities(h >> np.uint64(32), 2, edge)
                if sketched:
                    odd += _parities(_mix(h ^ np.uint64(_BASE)), SKETCHES, edge)
                place = np.arange(len(h)) - np.repeat(edge, n)
                # sets of up to three tokens match none but their equals
                length = np.where(n > 3, n - _ceil_share(n) + 1, 0)
                prefix = h[place < np.repeat(length, n)].astype(np.uint32)
                rows = pa.array(owner)
                made = [pa.array(number.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in (s1, s2)], pa.array(n.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in odd], _lists(prefix, length, pa.binary()), *([_wide(h, edge, n, WIDE)] if sketched else [])]
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(rows) for c in ("id", "th", "ask")], *made], ["id", "th", "ask", "line", "s1", "s2", "n", "parity", "parity2", *_SKETCH * sketched, "prefix", *("wide",) * sketched])

    return run


def _blocks_of(run: np.ndarray, rank: np.ndarray, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index rows (by place) and runs: a hot run's rows once for each other block, under a run for both."""
    at = np.arange(len(run))
    if not hot:
        return at, run
    slots = run >> np.uint32(32 - COUNT_BITS)
    heat = np.zeros(1 << COUNT_BITS, np.int64)
    heat[list(hot)] = list(hot.values())
    parts = heat[slots]
    cold = parts == 0
    rows, runs = [at[cold]], [run[cold]]
    for s in np.unique(parts[~cold]):
        mine = at[parts == s]
        block = (_mix(rank[mine].astype(np.uint64)) % np.uint64(s)).astype(np.int64)
        for other in range(s):
            pair = np.minimum(block, other) * s + np.maximum(block, other)
            rows.append(mine)
            runs.append((_mix(run[mine].astype(np.uint64) << np.uint64(24) ^ pair.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(rows), np.concatenate(runs)


def _index_rows(buckets: int, hot: dict[int, int], wanted: np.ndarray | None, labelled: bool):
    """Index rows of classes as (bucket, rows): many rows of a bucket in one binary value."""
    kind = LABELLED if labelled else ROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            bucket = (_mix(rows["run"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket)
            rows, bucket = rows[order], bucket[order]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(bucket[edge]), _lists(rows, np.diff(np.r_[edge, len(rows)]), pa.binary())], ["bucket", "rows"])

        for b in batches:
            parts = [np.frombuffer(x.as_buffer() or b"", "<u4") for x in b.column("prefix")]
            many = np.array([len(x) for x in parts])
            if not many.sum():
                continue
            run_of = np.concatenate(parts)
            of = np.repeat(np.arange(len(parts)), many)
            k = np.arange(len(run_of)) - np.repeat(np.cumsum(many) - many, many)
            if wanted is not None:
                keep = _has(wanted, run_of.astype(np.uint64))
                run_of, of, k = run_of[keep], of[keep], k[keep]
                if not len(run_of):
                    continue
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("rank", "parity", "parity2", "n", "ask", "quiet", *("label", "floor") * labelled)}
            at, runs = _blocks_of(run_of, col["rank"][of], hot)
            rows = np.empty(len(at), kind)
            rows["run"], rows["k"] = runs, k[at]
            own = of[at]
            rows["rank"] = col["rank"][own]
            rows["parity"], rows["parity2"] = (col[c][own].view(np.uint64) for c in ("parity", "parity2"))
            rows["n"] = col["n"][own].astype(np.uint32) | np.where(col["ask"][own], _ASKED, np.uint32(0)) | np.where(col["quiet"][own], _QUIET, np.uint32(0))
            if labelled:
                rows["label"], rows["floor"] = col["label"][own], col["floor"][own]
            held.append(rows)
            if sum(map(len, held)) * kind.itemsize > 16 << 20:
                yield out()
        if held:
            yield out()

    return run


class _Earliest:
    """The ``most`` earliest candidates of each row that was met, and whether it had more; all of asked rows."""

    def __init__(self, most: int, held: int):
        self.most, self.held = most, held
        self.x, self.y, self.n = (np.empty(0, np.int64) for _ in range(3))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Candidates of one run: rows ``x`` by place, class numbers ``y``."""
        self.x, self.y, self.n = np.r_[self.x, x], np.r_[self.y, y], np.r_[self.n, np.ones(len(x), np.int64)]
        if len(self.x) > self.held:
            self.trim()

    def trim(self) -> None:
        order = np.lexsort((self.y, self.x))
        x, y, n = self.x[order], self.y[order], self.n[order]
        edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
        size = np.diff(np.r_[edge, len(x)])
        place = np.arange(len(x)) - np.repeat(edge, size)
        total = np.add.reduceat(n, edge) if len(x) else n
        keep = place < self.most
        # the number of all candidates stays with the first
        n = np.ones(len(x), np.int64)
        n[edge] = total - np.minimum(size, self.most) + 1
        self.x, self.y, self.n = x[keep], y[keep], n[keep]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y), one for each node but the least of its component, that connect what the links (a, b) do."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[i], label[j])
        low = label.copy()
        np.minimum.at(low, label[i], m)
        np.minimum.at(low, label[j], m)
        while (low[low] != low).any():
            low = low[low]
        if (low == label).all():
            break
        label = low[label]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _candidates(most: int, labelled: bool, at_once: int, long_run: int, block: int, forest: bool = False):
    """(x, y, cut) for classes and their candidates, from index rows by bucket.

    With ``forest``: a forest of all candidate pairs of the bucket.

    Not asked: the ``most`` earliest candidates before x in a run; cut is the last of them if there were more.
    Asked: every candidate.  With labels: those of other labels, after the floor.
    ``at_once`` pairs are compared at once; runs of ``long_run`` rows are searched in blocks.
    """
    kind = LABELLED if labelled else ROW

    def fits(c: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs pass the filters, as places among the given."""
        n, k = c["n"], c["k"]
        # at most one in nine of both sets' tokens, without a division
        odd = np.bitwise_count(c["parity"][left] ^ c["parity"][right]).astype(np.int32)
        at = np.flatnonzero((NUM + DEN) * odd <= n[left] + n[right])
        left, right, odd = left[at], right[at], odd[at]
        a, b = n[left], n[right]
        allowed = a + b - 2 * _need(a + b)  # tokens that only one of both has
        good = odd + np.bitwise_count(c["parity2"][left] ^ c["parity2"][right]) <= allowed
        good &= DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)
        good &= 1 + np.minimum(a - k[left] - 1, b - k[right] - 1) >= _need(a + b)
        return at[good]

    def pairs_of(run: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places of rows sorted by run and size: each row meets those before it in its run that are long enough."""
        key = run << 31 | n
        low = np.searchsorted(key, run << 31 | _ceil_share(n))
        many = np.arange(len(n)) - low
        ends = np.cumsum(many)
        a = 0
        while a < len(n):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + at_once)))
            for first in range(0, int(many[a:z].max(initial=0)), at_once):
                m = np.clip(many[a:z] - first, 0, at_once)
                right = np.repeat(np.arange(a, z), m)
                yield np.repeat(low[a:z] + first, m) + np.arange(len(right)) - np.repeat(np.cumsum(m) - m, m), right
            a = z

    def search(r: np.ndarray) -> Iterator[pa.RecordBatch]:
        if labelled:
            r = r[np.argsort(r["run"])]
            edge = np.flatnonzero(np.r_[True, r["run"][1:] != r["run"][:-1]])
            mixed = np.minimum.reduceat(r["label"], edge) != np.maximum.reduceat(r["label"], edge)
            r = r[np.repeat(mixed, np.diff(np.r_[edge, len(r)]))]
            if not len(r):
                return
        key = r["run"].astype(np.int64) << 31 | (r["n"] & _SIZE)
        order = np.argsort(key)
        # a row that is alone in its run meets none
        other = np.diff(key[order] >> 31, prepend=-1, append=-1) != 0
        r = r[order[~(other[1:] & other[:-1])]]
        if not len(r):
            return
        asked, quiet = (r["n"] & _ASKED > 0) | forest, r["n"] & _QUIET > 0
        edge = np.flatnonzero(np.r_[True, r["run"][1:] != r["run"][:-1]])
        size = np.diff(np.r_[edge, len(r)])
        got, whole = _Earliest(most, at_once), []
        cols = {c: np.ascontiguousarray(r[c]) for c in ("parity", "parity2")} | {"n": (r["n"] & _SIZE).astype(np.int64), "k": r["k"].astype(np.int64)}

        def take(left: np.ndarray, right: np.ndarray) -> None:
            """Candidate pairs, in any order of both."""
            if forest:
                whole.append((r["rank"][left], r["rank"][right]))
                if sum(len(x) for x, _ in whole) > at_once:
                    whole[:] = [_forest(*(np.concatenate(c) for c in zip(*whole, strict=True)))]
                return
            swap = r["rank"][left] > r["rank"][right]
            early, late = np.where(swap, right, left), np.where(swap, left, right)
            if labelled:
                good = (r["label"][early] != r["label"][late]) & (r["rank"][early] > r["floor"][late])
                early, late = early[good], late[good]
            one = ~(asked[late] | quiet[late])
            got.add(late[one], r["rank"][early[one]])
            for x, y in ((late, early), (early, late)):
                all_ = asked[x]
                if all_.any():
                    whole.append((r["rank"][x[all_]], r["rank"][y[all_]]))

        short = np.repeat(size < long_run, size)
        places = np.flatnonzero(short)
        if len(places):
            for left, right in pairs_of(r["run"][places].astype(np.int64), cols["n"][places]):
                left, right = places[left], places[right]
                good = fits(cols, left, right)
                take(left[good], right[good])
        for a, m in zip(edge[size >= long_run], size[size >= long_run], strict=True):
            # from the earliest rows on; rows that have enough candidates leave, so a group of near copies costs little
            order = a + (np.lexsort((r["rank"][a : a + m], r["label"][a : a + m])) if labelled else np.argsort(r["rank"][a : a + m]))
            found = np.zeros(m, np.int64)
            busy = asked[order] if labelled else asked[order] | ~quiet[order]
            for y in range(0, m, block):
                early = order[y : y + block]
                live = np.arange(y + 1, m)
                if labelled:
                    if r["label"][early[0]] == r["label"][early[-1]]:
                        live = live[r["label"][order[live]] != r["label"][early[0]]]
                elif not asked[early].any():
                    live = live[asked[order[live]] | (busy[live] & (found[live] <= most))]
                for w in range(0, len(live), at_once // block + 1):
                    late = live[w : w + at_once // block + 1]
                    after = np.repeat(late, len(early))
                    pair = np.flatnonzero(np.tile(np.arange(y, y + len(early)), len(late)) < after)
                    left, right = np.tile(early, len(late))[pair], order[after[pair]]
                    good = fits(cols, left, right)
                    take(left[good], right[good])
                    np.add.at(found, after[pair][good], 1)
                if not len(live) and not labelled:
                    break
        got.trim()
        x, y, n = got.x, got.y, got.n
        if len(x):
            edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            size = np.diff(np.r_[edge, len(x)])
            more = np.add.reduceat(n, edge) > size
            last = np.where(more, y[edge + size - 1], -1)
            yield pa.RecordBatch.from_arrays([pa.array(r["rank"][x]), pa.array(y), pa.array(np.repeat(last, size))], ["x", "y", "cut"])
        if forest and whole:
            whole = [_forest(*(np.concatenate(c) for c in zip(*whole, strict=True)))]
        for x, y in whole:
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), -1))], ["x", "y", "cut"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for own, rows in zip(b.column("bucket").to_pylist(), b.column("rows"), strict=True):
                if own != bucket and held:
                    yield from search(np.concatenate(held))
                    held = []
                bucket = own
                held.append(np.frombuffer(rows.as_buffer().to_pybytes(), kind))
        if held:
            yield from search(np.concatenate(held))

    return scan


def _bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size with a bit for each id's low bits."""
    slot = F.col(column).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    return _merged(ids.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")), SIEVE_BITS)


def _merged(words: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits from rows (w, b) of its words."""
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _has(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = ids.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _runs(b: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([np.empty(0, "<u4"), *[np.frombuffer(x.as_buffer() or b"", "<u4") for x in b.column("prefix")]])


def _slot_counts(least: int):
    """How often a task's prefixes name runs, by the runs' top ``COUNT_BITS`` bits, from ``least`` on; all of them at slot -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            counts += np.bincount(_runs(b) >> np.uint32(32 - COUNT_BITS), minlength=1 << COUNT_BITS)
        at = np.flatnonzero(counts >= least)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[counts.sum(), counts[at]])], ["slot", "n"])

    return run


def _named_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a bitmap of the runs that prefixes name."""
    named = np.zeros(1 << RUN_BITS, bool)
    for b in batches:
        named[_runs(b) & np.uint32((1 << RUN_BITS) - 1)] = True
    words = np.packbits(named, bitorder="little").view("<i8")
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["w", "b"])


def _place(doc: Column, line: Column) -> Column:
    """Key of a line by its document's key and its number, as ``_lines_at`` has it."""
    return doc.bitwiseXOR(line.cast("long") * F.lit(_STEP))


def _lines_at(places: np.ndarray, texts: list[bytes], doc: np.ndarray) -> list[bytes]:
    """Lines of the texts whose place the bitmap may hold."""
    cut = [t.split(b"\n") for t in texts]
    many = np.array([len(x) for x in cut], np.int64)
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    lines = [x for c in cut for x in c]
    return [lines[i] for i in np.flatnonzero(_has(places, np.repeat(doc, many) ^ number * _STEP))]


def _token_sets(documents: np.ndarray, lines: np.ndarray, places: np.ndarray | None, split: Callable):
    """Token sets of lines that the bitmaps name; a superset of those asked for.  With ``places`` only lines that stand there are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _small(whole):
                b = b.filter(pa.array(_has(documents, b.column("doc").to_numpy(zero_copy_only=False))))
                texts = _texts(b)
                if places is not None:
                    texts = _lines_at(places, texts, b.column("doc").to_numpy(zero_copy_only=False))
                h, line, _, _ = split(texts)
                if not len(h):
                    continue
                h, line = _distinct(h, line)
                edge = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                n = np.diff(np.r_[edge, len(h)])
                s1, s2 = (np.add.reduceat(x, edge).view(np.int64) for x in (h, _mix(h)))
                # one of equal sets
                keep = np.flatnonzero(_has(lines, s1))
                keep = keep[np.unique(np.stack([s1[keep], s2[keep]]), axis=1, return_index=True)[1]] if len(keep) else keep
                yield pa.RecordBatch.from_arrays([pa.array(s1[keep]), pa.array(s2[keep]), pa.array([h[edge[i] : edge[i] + n[i]].astype("<u8").tobytes() for i in keep], pa.binary())], ["s1", "s2", "tokens"])

    return run


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y) of (y, salt, rank, tokens) rows where rank x matches rank y, whose own row comes first."""
    last, last_key = np.empty(0, np.uint64), (-1, -1)
    for b in batches:
        if not b.num_rows:
            continue
        y, salt, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "salt", "rank"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in b.column("tokens")]
        n = np.array([len(x) for x in sets])
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        first = rank == y
        place = np.cumsum(first)  # 0: that of the batch before
        at = np.flatnonzero(first)
        own_y, own_salt, own_n = np.r_[last_key[0], y[at]], np.r_[last_key[1], salt[at]], np.r_[len(last), n[at]]
        # tokens of a place, told apart from those of others
        named = lambda tokens, of: tokens ^ _mix(of.astype(np.uint64) + np.uint64(1))
        base = np.sort(np.r_[named(last, np.zeros(len(last), np.int64)), named(flat[first[row]], place[row[first[row]]])])
        other = np.flatnonzero(~first[row])
        key = named(flat[other], place[row[other]])
        hit = np.searchsorted(base, key)
        hit = base[np.minimum(hit, len(base) - 1)] == key if len(base) else np.zeros(len(key), bool)
        both = np.bincount(row[other][hit], minlength=len(sets))
        good = ~first & (own_y[place] == y) & (own_salt[place] == salt) & (DEN * both >= NUM * (n + own_n[place] - both))
        yield pa.RecordBatch.from_arrays([pa.array(rank[good]), pa.array(y[good])], ["x", "y"])
        if len(at):
            last, last_key = sets[at[-1]].copy(), (y[at[-1]], salt[at[-1]])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], shared: int) -> np.ndarray:
    """Tokens that each two different sets have in common, ``shared`` different tokens at once."""
    one, two = np.concatenate(left), np.concatenate(right)
    if left is right:
        names, n = np.unique(one, return_counts=True)
        names = names[n > 1]
    else:
        names = np.intersect1d(one, two)
    both = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for flat, sets in ((one, left), (two, right)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
        hit = names[at] == flat if len(names) else np.zeros(len(flat), bool)
        sides.append((row[hit], at[hit]))
    for a in range(0, len(names), shared):
        z = min(len(names), a + shared)
        m = []
        for (row, at), n in zip(sides, (len(left), len(right)), strict=True):
            own = (at >= a) & (at < z)
            x = np.zeros((n, z - a), np.float32)
            x[row[own], at[own] - a] = 1
            m.append(x)
        both += m[0] @ m[1].T
    return both.astype(np.int64)


def _counted(shared: int):
    """(x, y, others) of (label, place, one, rank, block, copies, tokens) rows: of each class its earliest match there before it, and copies of all its matches there.

    ``one``: the place compares a block with itself, else two blocks with each other.
    """

    def place(one: bool, rank: np.ndarray, block: np.ndarray, copies: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # several texts may hold the set of a class
        order = np.unique(rank, return_index=True)[1]
        rank, block, copies, label, sets = rank[order], block[order], copies[order], label[order], [sets[i] for i in order]
        low = np.arange(len(rank)) if one else np.flatnonzero(block == block.min())
        high = low if one else np.flatnonzero(block != block.min())
        if not len(high):
            return
        n = np.array([len(x) for x in sets])
        left = [sets[i] for i in low]
        both = _overlaps(left, left if one else [sets[i] for i in high], shared)
        good = DEN * both >= NUM * (n[low][:, None] + n[high][None, :] - both)
        if one:
            good &= (label[:, None] == label) & (block[:, None] == block)
            np.fill_diagonal(good, False)
        for x, y, match in ((low, high, good),) if one else ((low, high, good), (high, low, good.T)):
            found = match.any(axis=1)
            first = rank[y][match.argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(rank[x][found]), pa.array(np.where(first < rank[x], first, -1)[found]), pa.array((match[found] @ copies[y]).astype(np.int64))], ["x", "y", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, few = None, [], []

        def met(parts: list[tuple], one: bool) -> Iterator[pa.RecordBatch]:
            return place(one, *[np.concatenate([h[i] for h in parts]) for i in range(4)], [x for h in parts for x in h[4]])

        def out() -> Iterator[pa.RecordBatch]:
            """What is held; small groups wait until they are many."""
            n = sum(len(h[0]) for h in held)
            if not key[2] or n >= TOGETHER:
                yield from met(held, key[2])
                return
            few.extend(held)
            if sum(len(h[0]) for h in few) >= TOGETHER:
                yield from met(few, True)
                few.clear()

        for b in batches:
            if not b.num_rows:
                continue
            label, at, one, rank, block, copies = (b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "place", "one", "rank", "block", "copies"))
            # copies, as the batch's memory is given back
            sets = [np.frombuffer(x.as_buffer().to_pybytes(), "<u8") for x in b.column("tokens")]
            edge = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (at[1:] != at[:-1])])
            for a, z in zip(edge, [*edge[1:], len(label)], strict=True):
                if held and key != (label[a], at[a], one[a]):
                    yield from out()
                    held = []
                key = (label[a], at[a], one[a])
                held.append((rank[a:z].copy(), block[a:z].copy(), copies[a:z].copy(), label[a:z].copy(), sets[a:z]))
        if held:
            yield from out()
        if few:
            yield from met(few, True)

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, id=id_col, text=text_col).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))


class Join:
    """Lines of (id, text, th) rows as ``split`` gives them, in classes of equal token sets.

    ``lines``: (id, th, ask, line, s1, s2).  ``classes``: (rank, s1, s2, first, copies, ask, n, parity, parity2, prefix), the
    rank in order of ``first``, the class's first line.  ``sketched``: classes have what ``likely`` compares.
    """

    def __init__(self, rows: DataFrame, split: Callable, asked: Column | None = None, sketched: bool = True):
        bound_arrow(rows.sparkSession)
        self.rows, self.split, self.whole = rows, split, asked is not None
        kind = rows.schema["id"].dataType.simpleString()
        rows = rows.withColumn("ask", F.coalesce(asked, F.lit(False)) if asked is not None else F.lit(False))
        sketch = _SKETCH * sketched
        schema = [f"id {kind}, th long, ask boolean, line int, s1 long, s2 long, n int, parity long, parity2 long", *[f"{c} long" for c in sketch], "prefix binary", *["wide binary"] * sketched]
        self.lines = scratch(rows.mapInArrow(_line_rows(rarity_table(rows, split), split, sketched), ", ".join(schema)), "lines")
        place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("line").alias("line"))
        each = self.lines.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("ask").alias("ask"), *[F.first(c).alias(c) for c in ("n", "parity", "parity2", *sketch, "prefix", *("wide",) * sketched)])
        order = [F.col(f"first.{c}") for c in ("none", "id", "th", "line")]
        self.classes = scratch(each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "line-classes")
        wide, self.lines = self.lines, scratch(self.lines.select("id", "th", "ask", "line", "s1", "s2"), "lines")
        discard(wide)
        # a task leaves out slots below its share of RUN_ROWS, so a run that is not split has twice that at most
        tasks = max(1, self.classes.rdd.getNumPartitions())
        got = self.classes.select("prefix").mapInArrow(_slot_counts(max(1, RUN_ROWS // tasks)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        got = {r["slot"]: r["n"] for r in got.filter((F.col("slot") < 0) | (F.col("n") > RUN_ROWS)).collect()}  # one for each RUN_ROWS rows at most
        self.index_rows = got.pop(-1, 0)
        self.hot = {slot: -(-n // RUN_ROWS) for slot, n in got.items()}

    def candidates(self, most: int, part: DataFrame | None = None, wanted: np.ndarray | None = None, labelled: bool = False, forest: bool = False) -> DataFrame:
        """(x, y, cut) as a scratch table: of each x that asks its earliest candidates; those up to the least cut of x are complete."""
        spark = self.rows.sparkSession
        source = (self.classes.withColumn("quiet", F.lit(False)) if part is None else part).filter(F.length("prefix") > 0)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.index_rows // BUCKET_ROWS))
        index = source.select("rank", "parity", "parity2", "n", "ask", "quiet", "prefix", *("label", "floor") * labelled).mapInArrow(_index_rows(4 * parts, self.hot, wanted, labelled), "bucket long, rows binary")
        index = index.repartition(parts, "bucket").sortWithinPartitions("bucket")
        found = index.mapInArrow(_candidates(most, labelled, PAIRS, LONG_RUN, BLOCK, forest), "x long, y long, cut long")
        return scratch(found.groupBy("x", "y").agg(F.min(F.when(F.col("cut") >= 0, F.col("cut"))).alias("cut")), "line-candidates")

    def among(self, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Classes whose rank may be among the given (one column), and the others."""
        return sieved(self.classes, F.xxhash64("rank"), ranks.toDF("rank").select(F.xxhash64("rank")), "line-sieve")

    def complete(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs that stand before each x's least cut, and (x, upto) with that cut, null where nothing was left out."""
        upto = found.groupBy("x").agg(F.min("cut").alias("upto"))
        return found.drop("cut").join(upto, "x").filter(F.col("upto").isNull() | (F.col("y") <= F.col("upto"))).select("x", "y"), upto

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) whose token sets match, as a scratch table.

        Token sets go once to each place where they are compared: that of y, or
        one of several if more than ``MEET`` pairs have this y.
        """
        salts = scratch(pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("long").alias("salts")), "line-salts")
        there = skew_join(pairs.select("x", "y"), salts, ["y"]).select(F.col("x").alias("rank"), "y", F.pmod(F.xxhash64("x"), F.col("salts")).alias("salt"))
        there = there.unionByName(salts.select(F.col("y").alias("rank"), "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")))
        key = F.xxhash64("first.id", "first.th")
        mine, _ = self.among(there.select("rank"))
        named = scratch(skew_join(there, mine.select("rank", "s1", "s2", key.alias("doc"), F.col("first.line").alias("line")), ["rank"]), "line-named")
        met = self.sets_of(named).select("y", "salt", "rank", "tokens")
        met = met.repartition("y", "salt").sortWithinPartitions("y", "salt", F.col("rank") != F.col("y"))
        out = scratch(met.mapInArrow(_matching, "x long, y long").distinct(), "line-verified")
        discard(salts, named)
        return out

    def sets_of(self, named: DataFrame) -> DataFrame:
        """Rows of a scratch table with (s1, s2, doc, line) and ``tokens``, some more than once; gathered again from the first lines of the classes in question only."""
        named_docs = scratch(named.select("doc").distinct(), "line-texts")
        texts = self.rows.select("text", F.xxhash64("id", "th").alias("doc"))
        if value_bytes(named_docs)[1] <= BROADCAST_BYTES:
            texts = texts.join(F.broadcast(named_docs), "doc", "left_semi")
        # of texts that are split by lines, only lines in question
        by_line = getattr(self.split, "func", self.split) is tokenize
        places = _bitmap(named.select(_place(F.col("doc"), F.col("line")).alias("place")), "place") if by_line else None
        sets = texts.mapInArrow(_token_sets(_bitmap(named, "doc"), _bitmap(named, "s1"), places, self.split), "s1 long, s2 long, tokens binary")
        few = value_bytes(named)[1] <= BROADCAST_BYTES
        return sets.join(F.broadcast(named) if few else named, ["s1", "s2"])

    def counted(self, connect: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(x, y, others) of each class with a match, a scratch table: the earliest match before it, else null, and the lines of all its matches.

        ``connect`` gives (node, label) of the components of links (a, b).
        """
        found = self.candidates(0, forest=True)
        label = scratch(connect(found.select(F.col("x").alias("a"), F.col("y").alias("b"))), "line-labels")
        group = label.select(F.col("node").alias("rank"), "label").unionByName(label.select(F.col("label").alias("rank"), "label").distinct())
        size = group.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("blocks"))
        group = skew_join(scratch(group, "line-groups"), scratch(size, "line-sizes"), ["label"])
        mine = self.among(group.select("rank"))[0].select("rank", "s1", "s2", "copies", F.xxhash64("first.id", "first.th").alias("doc"), F.col("first.line").alias("line"))
        named = scratch(mine.join(group, "rank").withColumn("block", F.pmod(F.xxhash64("rank"), "blocks")), "line-named")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        at = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
        met = self.sets_of(named).select("label", "rank", "block", "blocks", "copies", "tokens", other.alias("other")).select("label", at.alias("place"), (F.col("block") == F.col("other")).alias("one"), "rank", "block", "copies", "tokens")
        met = met.repartition("label", "place").sortWithinPartitions("label", "place")
        out = met.mapInArrow(_counted(SHARED), "x long, y long, others long").groupBy("x").agg(F.min(F.when(F.col("y") >= 0, F.col("y"))).alias("y"), F.sum("others").alias("others"))
        out = scratch(out, "line-counted")
        discard(found, label, named)
        return out

    def matches(self) -> DataFrame:
        """(x, y) pairs that match, a scratch table: of every class its earliest match, of asked ones all.

        The first round verifies the earliest likely candidate of each class, later
        ones, for the few classes left, all of them.
        """
        good, part, wanted, most = [], None, None, FIRST
        while True:
            found = self.candidates(most, part, wanted)
            pairs, upto = self.complete(found)
            pairs = self.likely(pairs)
            tried = pairs if self.whole or part is not None else pairs.groupBy("x").agg(F.min("y").alias("y"), F.count(F.lit(1)).alias("n"))
            good.append(self.verified(tried.select("x", "y")))
            # those without an earlier match whose runs hold more, or that have more than was verified
            open_ = upto.filter(F.col("upto").isNotNull()).select("x")
            if "n" in tried.columns:
                open_ = open_.unionByName(tried.filter("n > 1").select("x")).distinct()
            open_ = scratch(open_.join(good[-1].filter("y < x"), "x", "left_anti").select(F.col("x").alias("rank")), "line-undecided")
            rows, size = value_bytes(open_)
            discard(found, pairs)
            if not rows:
                break
            most *= 64
            wanted = self.runs_of(open_)
            # they alone search, among all that their runs hold
            mine = open_.withColumn("own", F.lit(True))
            part = self.classes.drop("ask").join(F.broadcast(mine) if size <= BROADCAST_BYTES else mine, "rank", "left").withColumn("quiet", F.col("own").isNull()).withColumn("ask", F.lit(False))
        every = good[0]
        for more in good[1:]:
            every = every.unionByName(more)
        # several may match in a later round: the earliest is the class's
        if not self.whole:
            every = every.filter("y < x").groupBy("x").agg(F.min("y").alias("y"))
        done = scratch(every.distinct(), "line-matches")
        discard(open_, *good)
        return done

    def runs_of(self, ranks: DataFrame) -> np.ndarray:
        """Bitmap of the runs that the prefixes of the given classes name."""
        return _merged(self.among(ranks.select("rank"))[0].join(ranks, "rank", "left_semi").select("prefix").mapInArrow(_named_runs, "w long, b long"), RUN_BITS)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches leave a match possible, as a scratch table: fewer to verify."""
        pairs = scratch(pairs.select("x", "y"), "line-pairs")
        classes, _ = self.among(pairs.select("x").union(pairs.select("y")))
        mine = lambda to: classes.select(F.col("rank").alias(to), *[F.col(c).alias(f"{to}_{c}") for c in ("n", *_SKETCH, "wide")])
        both = F.col("x_n") + F.col("y_n")
        need = F.ceil(F.lit(NUM) * both / (NUM + DEN))
        fits = functools.reduce(operator.add, [F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in _SKETCH]) <= both - 2 * need
        found = skew_join(pairs, mine("y"), ["y"]).join(mine("x"), "x").filter(fits).select("x", "y", "x_n", "y_n", "x_wide", "y_wide")
        out = scratch(found.mapInArrow(_wide_fits, "x long, y long"), "line-likely")
        discard(pairs)
        return out

    def components(self, connect: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
        """(node, label) of linked classes; ``connect`` gives them for links (a, b).

        Earliest matches are links already, and so are ``known`` ones (x, y).  Of the other candidates only those
        between classes with different labels are verified, in rounds that go on from where a
        class's last one ended.
        """
        links = self.matches()
        floors = scratch(links.filter("y < x").groupBy("x").agg(F.min("y").alias("floor")).withColumnRenamed("x", "rank"), "line-floors")
        if known is not None:
            matched, links = links, scratch(links.unionByName(known), "line-matches")
            discard(matched)
        most = 8
        while True:
            label = scratch(connect(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "line-labels")
            if floors.isEmpty():
                discard(floors, links)
                return label
            # a class without a link keeps its own number and asks for nothing
            linked, alone = (c.select("rank", "parity", "parity2", "n", "prefix") for c in self.among(label.select("node").union(floors.select("rank"))))
            part = linked.join(label.withColumnRenamed("node", "rank"), "rank", "left").join(floors, "rank", "left")
            part = part.unionByName(alone, allowMissingColumns=True)
            part = scratch(part.select("rank", "parity", "parity2", "n", "prefix", F.coalesce("label", "rank").alias("label"), F.coalesce("floor", "rank").alias("floor"), F.lit(False).alias("ask"), F.col("floor").isNull().alias("quiet")), "line-part")
            found = self.candidates(most, part, self.runs_of(floors), labelled=True)
            pairs, upto = self.complete(found)
            pairs = self.likely(pairs)
            more = self.verified(pairs)
            after = scratch(upto.filter(F.col("upto").isNotNull()).select(F.col("x").alias("rank"), F.col("upto").alias("floor")), "line-floors")
            grown = scratch(links.unionByName(more), "line-matches")
            discard(label, part, found, pairs, more, floors, links)
            floors, links, most = after, grown, most * 8

    def drop(self) -> None:
        discard(self.lines, self.classes)


def verdicts(rows: DataFrame, least: int = MIN_TOKENS, whole: bool = False) -> DataFrame:
    """(id, th, removed, n_links, least) for each document with a line that matches another, as a scratch table.

    Each later line has a link to the earliest line that it matches; ``n_links``
    counts the document's ends of those links, or with ``whole`` all lines
    elsewhere that match one of the document's.
    """
    from .simhash import components  # which imports this module

    join = Join(rows, partial(tokenize, least=least), sketched=not whole)
    pairs = join.counted(components) if whole else join.matches()
    earliest = pairs.filter("y < x").groupBy("x").agg(F.min("y").alias("y"))
    some, others = join.among(pairs.select("x").union(pairs.filter("y is not null").select("y")))
    far = skew_join(earliest, some.select(F.col("rank").alias("y"), F.col("first").alias("far")), ["y"]).select(F.col("x").alias("rank"), "far")
    copies = some.select(F.col("rank").alias("y"), "copies")
    if whole:
        links = pairs.select(F.col("x").alias("rank"), "others")
    else:
        links = copies.withColumnRenamed("y", "x").join(earliest, "x").select(F.col("y").alias("rank"), "copies")
        links = links.groupBy("rank").agg(F.sum("copies").alias("others"))
    found, alone = (c.select("rank", "s1", "s2", "first", "copies") for c in (some, others))
    found = found.join(far, "rank", "left").join(links, "rank", "left").unionByName(alone.filter("copies > 1"), allowMissingColumns=True)
    found = found.filter((F.col("copies") > 1) | F.col("far").isNotNull() | F.col("others").isNotNull())
    found = scratch(found.select("s1", "s2", "first", "far", F.when(F.lit(whole) | F.col("far").isNull(), F.col("copies") - 1).otherwise(0).alias("own"), F.coalesce("others", F.lit(0)).alias("others"), "copies"), "line-verdicts")
    lines = join.lines.select("id", "th", "line", "s1", "s2")
    lines, _ = sieved(lines, F.col("s1"), found.select("s1"), "line-sieve")
    judged = skew_join(lines, found.drop("copies"), ["s1", "s2"], counts=found.select("s1", "s2", F.col("copies").alias("n")))
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("line").alias("line"))
    target = F.coalesce("far", "first")
    gone = target < place
    ends = F.col("own") + F.col("others") if whole else F.when(F.col("first") == place, F.col("own") + F.col("others")).otherwise(0) + gone.cast("long")
    # rows that repeat are one document: their lines are told apart by number
    one = F.struct("line", gone.alias("gone"), ends.alias("ends"))
    each = judged.groupBy("id", "th").agg(F.sort_array(F.collect_set(one)).alias("each"), F.min(F.struct(target["none"].alias("none"), target["id"].alias("id"))).alias("least"))
    removed = F.transform(F.filter("each", lambda x: x["gone"]), lambda x: x["line"])
    out = scratch(each.select("id", "th", removed.alias("removed"), F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + x["ends"]).alias("n_links"), "least"), "line-documents")
    discard(found, pairs)
    join.drop()
    return out


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_TOKENS, whole: bool = True) -> DataFrame:
    """For every document: lines, removed lines, links and class.

    ``n_links`` counts the lines elsewhere that match one of the document's
    lines; without ``whole`` the ends of the links from each later line to
    its class's representative, the earliest line that it matches.  ``class_id`` is
    the least id that holds the earliest match of a line,
    the document's own if no other does; ``removed_lines`` are numbers from 0.
    """
    rows = _rows(docs, id_col, text_col)
    found = verdicts(rows, least, whole)
    text = F.coalesce("text", F.lit(""))
    n = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    base = rows.select("id", "th", n.alias("n_lines"))
    f = found.toDF("f_id", "f_th", "removed", "n_links", "least")
    out = base.join(f, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    own = F.when(F.col("least").isNull() | F.col("least.none"), F.col("id")).otherwise(F.least("least.id", "id"))
    return out.select(F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("class_id"), F.coalesce(F.concat_ws(",", "removed"), F.lit("")).alias("removed_lines"))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, least: int = MIN_TOKENS) -> DataFrame:
    """The documents without later matches of lines; ``count_col`` is set to the new length."""
    names = docs.columns
    at = lambda c: f"__d{names.index(c)}"
    inner = docs.toDF(*[f"__d{i}" for i in range(len(names))]).withColumn("__th", F.xxhash64(F.coalesce(at(text_col), F.lit(""))))
    found = verdicts(_rows(docs, id_col, text_col), least).filter(F.size("removed") > 0).select(F.col("id").alias("__id"), F.col("th").alias("__fh"), "removed")
    # whole texts are shuffled only where lines may go
    some, others = sieved(inner, F.xxhash64(at(id_col), "__th"), found.select(F.xxhash64("__id", "__fh")))
    out = some.join(found.hint("merge"), F.col(at(id_col)).eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__fh")), "left").unionByName(others, allowMissingColumns=True)
    hit = F.col("removed").isNotNull()
    lines = F.split(F.col(at(text_col)), "\n", -1)
    kept = F.array_join(F.array_compact(F.transform(lines, lambda x, i: F.when(~F.array_contains("removed", i), x))), "\n")
    out = out.withColumn("__new", F.when(hit, kept).otherwise(F.col(at(text_col))))
    out = out.filter(~hit | F.col("__new").rlike(r"[^\x20\x09-\x0D]"))
    cols = [F.col("__new") if c == text_col else F.when(hit, F.length("__new").cast("long")).otherwise(F.col(at(c))) if c == count_col else F.col(at(c)) for c in names]
    return out.select(*[c.alias(f"__o{i}") for i, c in enumerate(cols)]).toDF(*names)
