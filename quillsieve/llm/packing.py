"""Lexical retrieval packing: sequences of neighbouring documents, found by BM25.

Documents become token ids and a final end id.  They are sharded by lexical
signatures, so that similar documents meet; each shard keeps a BM25 inverted
index over its tokens, with inverse document frequencies and the mean length
counted over the whole corpus.  All terms of a seed score: those that many of
the block's documents hold by a matrix product for the whole block, the others
from their postings.  A seed document opens a window; its best unused
neighbours fill the window in order of their scores, and the last one is cut
where the window ends and seeds the next.  A window that nothing fills at a
shard's end is cut into sequences whose lengths are powers of two, so no
sequence needs padding.

Shards are ranges of (signature, id), so one signature that holds a third of
all rows spreads over many shards; a task indexes ``BLOCK_TOKENS`` tokens at a
time, which bounds its memory.

Defined results: a null text is empty and has the end id alone; texts of any
length are packed whole; equal texts keep their own rows; rows without an id
and repeated rows are packed like others; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, pick, scratch

LENGTH = 1024
END = 0
BLOCK_TOKENS = 1 << 21
BLOCK_DOCS = 2048
QUERY_TERMS = None  #: no cut: all terms of a seed score
DENSE_SHARE = 32  #: a term that over 1 / so many of a block's documents hold is scored for all seeds at once
NEIGHBOURS = 32  #: retrieved at a time; a window that takes them all retrieves again
K1, B = 1.2, 0.75
CHUNK = 1 << 14  #: characters from which a text is cut

#: Before a space that a visible character follows, byte-level BPE always begins a token.
_CUT = re.compile(r" (?=\S)")
#: Pre-tokenization of byte-level BPE.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Scripts whose character classes have long been settled; other texts are left to the tokenizers library.
_SETTLED = re.compile(r"[^\x00-\u024f\u2010-\u2027\u20ac]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranks_of(path: str) -> dict[bytes, int] | None:
    """A tokenizer file's vocabulary as merge ranks, if its ids follow its merges; else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
    pre = model.get("pre_tokenizer") or {}
    if model["model"]["type"] != "BPE" or model.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    # byte-level alphabets: printable bytes stand for themselves, the others for U+0100 and on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in model.get("added_tokens", ())}
    return {bytes(back[c] for c in t): i for t, i in vocabulary.items() if t not in special}


class Tokens:
    """Ids of whole texts, as the tokenizers library gives them for the file.

    Where that is known to be equal, an encoder built from the same file's
    vocabulary and merges is used, which is several times as fast.  Long texts
    are cut where a token always begins.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = None
        if ranks := _ranks_of(path):
            import tiktoken

            encoding = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.fast = functools.partial(encoding.encode_to_numpy, disallowed_special=())

    def chunks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHUNK and (m := _CUT.search(text, at + CHUNK)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, text: str) -> np.ndarray:
        if self.fast and len(text) <= 2 * CHUNK and not _SETTLED.search(text):
            return self.fast(text)
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> np.ndarray:
        if self.special and self.special.search(text):  # added tokens have ids of their own, and may take what stands beside them
            parts = [np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")]
        else:
            parts = [self.encode(c) for c in self.chunks(text)]
        return np.concatenate([*parts, np.array([END], "<u4")]).astype("<u4", copy=False)


@functools.lru_cache(maxsize=4)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def _ranks(seed: int, size: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(size).astype(np.uint32)


def _tokenize(path: str, vocabulary: int):
    """Rows of documents, then of the task's document frequencies (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens_of(path)
        df = np.zeros(vocabulary, np.int64)
        one, two = _ranks(1, vocabulary), _ranks(2, vocabulary)
        last = np.zeros(vocabulary, np.int64)  # where each id stood last in the text
        kind = None
        for b in batches:
            kind = b.schema.field("id").type
            ids, n, k1, k2 = [], [], [], []
            for x in b.column("text"):
                got = model.ids(x.as_py() or "")
                ids.append(got.tobytes() if vocabulary > 1 << 16 else got.astype("<u2").tobytes())
                n.append(len(got))
                at = np.arange(len(got))
                last[got] = at
                got = got[last[got] == at]  # each id once
                k1.append(int(one[got].min()))
                k2.append(int(two[got].min()))
                df[got] += 1
            rows = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), b.column("id"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["kind", "id", "ids", "n", "k1", "k2"])
        at = np.flatnonzero(df)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.nulls(len(at), kind), pa.nulls(len(at), pa.binary()), pa.array(df[at]), pa.array(at), pa.array(at)], ["kind", "id", "ids", "n", "k1", "k2"])

    return run


class Shard:
    """BM25 inverted index over a block of documents, with corpus statistics."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        n = np.array([len(x) for x in ids])
        cells = np.sort(np.repeat(np.arange(len(ids)) << 32, n) | np.concatenate(ids).astype(np.int64))
        edge = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        term, doc = cells[edge] & 0xFFFFFFFF, (cells[edge] >> 32).astype(np.int32)
        tf = np.diff(np.r_[edge, len(cells)]).astype(np.float32)
        length = n.astype(np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        # multiples of a power of two, so that sums are exact in any order and equal documents tie
        weight = np.rint(weight.astype(np.float64) * (1 << 20)) / (1 << 20)
        self.size = len(ids)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        df = np.diff(self.first)
        dense = df * DENSE_SHARE > self.size
        # each document's query: all its terms; here those that few documents hold
        few = ~dense[term]
        self.query = np.split(term[few], np.searchsorted(doc[few], np.arange(1, self.size)))
        self.base = np.zeros((self.size, self.size))
        many = np.flatnonzero(dense)
        for a in range(0, len(many), 256):
            part = many[a : a + 256]
            n = df[part]
            row = np.repeat(np.arange(len(part)), n)
            at = np.arange(len(row)) + np.repeat(self.first[part] - (np.cumsum(n) - n), n)
            held = np.zeros((len(part), self.size))
            held[row, self.doc[at]] = self.weight[at]
            self.base += (held > 0).astype(np.float64).T @ held

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents by falling score, ties by place."""
        score = self.base[seed].copy()
        if len(t := self.query[seed]):
            n = self.first[t + 1] - self.first[t]
            at = np.arange(n.sum()) + np.repeat(self.first[t] - (np.cumsum(n) - n), n)
            score += np.bincount(self.doc[at], self.weight[at], self.size)
        score[~unused] = 0
        best = np.argpartition(-score, NEIGHBOURS)[:NEIGHBOURS] if self.size > NEIGHBOURS else np.arange(self.size)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))]


def _pack(idf: np.ndarray, mean: float, length: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        sequence = TaskContext.get().partitionId() << 40
        kind = None
        window: list[tuple] = []  # (id, start, n, whole document's ids) of the open window
        room = length

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for i, start, n, ids in pieces:
                cut = ids[start : start + n].astype("<u4").tobytes()
                out.append((i, start, n, zlib.crc32(cut), len(ids), sequence, at, *[cut] * keep_ids))
                at += n
            sequence += 1

        def add(i, ids: np.ndarray, start: int) -> int:
            """Puts what fits into the window; returns the next start."""
            nonlocal room, window
            n = min(room, len(ids) - start)
            window.append((i, start, n, ids))
            room -= n
            if not room:
                close(window)
                window, room = [], length
            return start + n

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * (7 + keep_ids)
            kinds = [kind, *[pa.int64()] * 6, *[pa.binary()] * keep_ids]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids])

        def block(names: list, docs: list[np.ndarray]) -> None:
            shard = Shard(docs, idf, mean)
            unused = np.ones(len(docs), bool)
            next_seed = 0
            seed = None
            while True:
                if seed is None:
                    while next_seed < len(docs) and not unused[next_seed]:
                        next_seed += 1
                    if next_seed == len(docs):
                        return
                    seed, start = next_seed, 0
                    unused[seed] = False
                # whole windows of the seed, then its rest
                while start < len(docs[seed]):
                    start = add(names[seed], docs[seed], start)
                after = None
                while window and after is None:
                    near = shard.neighbours(seed, unused)
                    if not len(near):
                        break
                    for d in near:
                        unused[d] = False
                        end = add(names[d], docs[d], 0)
                        if end < len(docs[d]):
                            after = (int(d), end)
                        if not window or after:
                            break
                seed, start = after or (None, 0)

        wide = np.dtype("<u4") if len(idf) > 1 << 16 else np.dtype("<u2")
        names, docs, held = [], [], 0
        for b in batches:
            kind = b.schema.field("id").type
            for i, x in zip(b.column("id").to_pylist(), b.column("ids"), strict=True):
                names.append(i)
                docs.append(np.frombuffer(x.as_buffer().to_pybytes(), wide))
                held += len(docs[-1])
                if held >= BLOCK_TOKENS or len(docs) >= BLOCK_DOCS:
                    block(names, docs)
                    names, docs, held = [], [], 0
                    yield flush()
        if docs:
            block(names, docs)
        # the open window's tokens, in sequences of powers of two
        rest = length - room
        for k in range(rest.bit_length() - 1, -1, -1):
            if not rest >> k & 1:
                continue
            need, part = 1 << k, []
            while need:
                i, start, n, ids = window.pop(0)
                part.append((i, start, min(n, need), ids))
                if n > need:
                    window.insert(0, (i, start + need, n - need, ids))
                need -= min(n, need)
            close(part)
        if out:
            yield flush()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""
    bound_arrow(docs.sparkSession)
    path = path or tokenizer_path()
    vocabulary = tokens_of(path).model.get_vocab_size()
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    table = scratch(rows.mapInArrow(_tokenize(path, vocabulary), f"kind int, id {kind}, ids binary, n long, k1 long, k2 long"), "pack-tokens")
    texts = table.filter("kind = 0")
    count, tokens = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # document frequencies: as many rows as the vocabulary has ids
    got = table.filter("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(vocabulary, np.float64)
    df[got.column("k1").to_numpy()] = got.column("n").to_numpy()
    idf = np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32)
    spread = texts.select("id", "ids", "k1", "k2").repartitionByRange(F.col("k1"), F.col("k2"), F.col("id"), F.xxhash64("ids")).sortWithinPartitions("k1", "k2", "id", F.xxhash64("ids"))
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return spread.select("id", "ids").mapInArrow(_pack(idf, tokens / max(count, 1), length, keep_ids), schema).withColumnRenamed("id", id_col)
