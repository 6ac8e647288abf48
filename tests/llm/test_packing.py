import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillsieve.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


ODD = ["", " ", "  a", "a  b", "a \n b", "a\n\n b \n\tc", "  x  y", "it's we'll  'tis", "<|endoftext|> a <|endoftext|>", "\x1c \x1d a", "日本 語 тест  🐶 x", "a　 b", "tab\t tab", "x " * 50 + " ", "ß ÀÉ ñ", "12 345  6", "é" * 300, "\u0085 a \u0085b", "a’s “q” – —"]


def test_ids_are_the_librarys(library, sample):
    mine = packing.Tokens(PATH)
    assert mine.fast
    for text in [*ODD, *[t for _, t, *_ in sample], "🐶".join(ODD)]:
        assert mine.ids(text).tolist() == library(text), repr(text[:60])


def test_added_tokens_have_their_own_ids(library):
    got = packing.Tokens(PATH).ids("a <|endoftext|> b").tolist()
    assert got == library("a <|endoftext|> b") and Tokenizer.from_file(PATH).token_to_id("<|endoftext|>") in got


PARTS = st.characters(max_codepoint=0x24F) | st.sampled_from(["‐", "–", "—", "‘", "’", "“", "”", "•", "…", "€", "\t", "\n", "  ", "'s", "12", "ab", " "])
SETTLED = st.lists(PARTS, max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(SETTLED)
def test_fast_encoder_gives_the_librarys_ids(text):
    mine = packing.tokens_of(PATH)
    assert mine.ids(text)[:-1].tolist() == mine.model.encode(text, add_special_tokens=False).ids


def test_small_chunks_give_the_same(library, sample, monkeypatch):
    for size in (7, 200):
        monkeypatch.setattr(packing, "CHUNK", size)
        mine = packing.Tokens(PATH)
        for text in [*ODD, *[t for _, t, *_ in sample[:40]]]:
            assert mine.ids(text).tolist() == library(text)


@pytest.mark.parametrize("text", ["a" + " " * 100_000 + "b", "x" * 60_000, "\n" * 40_000, "ab " * 40_000])
def test_long_runs(library, text):
    assert packing.Tokens(PATH).ids(text).tolist() == library(text)


def check(rows, docs, library):
    ids = {i: library(t) for i, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length >= 1 and p.doc_tokens == len(ids[i])
            cut = ids[i][p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    padding = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


@pytest.mark.parametrize("docs, tokens", [(2048, 1 << 21), (7, 1 << 21), (2048, 500)])
def test_every_id_is_packed_once(make, sample, library, monkeypatch, docs, tokens):
    monkeypatch.setattr(packing, "BLOCK_DOCS", docs)
    monkeypatch.setattr(packing, "BLOCK_TOKENS", tokens)
    rows = [(1000 + k, x) for k, x in enumerate(ODD)] + [(i, t) for i, t, *_ in sample] + [(5000, None), (5001, "w " * 30000)]
    check(packing.pack(make(rows, ["LENGTH", "ids"])).collect(), rows, library)


def test_neighbours_share_words(make):
    """Of two interleaved vocabularies, windows hold documents of one."""
    rows = [(k, " ".join(f"{'alpha' if k % 2 else 'omega'}{(k * 7 + j) % 40}" for j in range(60))) for k in range(200)]
    got = packing.pack(make(rows)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.sequence_id].add(r.doc_id % 2)
    assert sum(len(x) == 1 for x in by.values()) > 0.8 * len(by)


def test_bm25_finds_the_brute_force_best():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 300, rng.integers(5, 60)).astype("<u2") for _ in range(120)]
    df = np.zeros(300)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log1p((120 - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = np.mean([len(d) for d in docs])
    shard = packing.Shard(docs, idf, mean)
    unused = rng.random(120) > 0.3
    for seed in range(120):
        score = np.zeros(120)
        w = {t: float(idf[t]) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[seed]) / mean)) for t, c in zip(*np.unique(docs[seed], return_counts=True), strict=True)}
        for t in sorted(w, key=lambda t: (-np.float32(w[t]), t))[: packing.QUERY_TERMS]:
            for k, d in enumerate(docs):
                if c := (d == t).sum():
                    score[k] += idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean))
        score[~unused] = 0
        got = shard.neighbours(seed, unused)
        assert len(got) == min(packing.NEIGHBOURS, int((score > 0).sum()))
        assert np.allclose(np.sort(score[got]), np.sort(score)[::-1][: len(got)][::-1], rtol=1e-3)


def test_all_terms_of_long_seeds_score():
    """Seeds of 60 to 400 distinct terms, frequent and rare ones, against a brute force without any cut."""
    rng = np.random.default_rng(1)
    p = 1 / np.arange(1, 2001)
    docs = [rng.choice(2000, rng.integers(150, 1500), p=p / p.sum()).astype("<u2") for _ in range(150)]
    assert min(len(np.unique(d)) for d in docs) > 30
    tf = np.stack([np.bincount(d, minlength=2000) for d in docs])
    df = (tf > 0).sum(axis=0)
    idf = np.log1p((150 - df + 0.5) / (df + 0.5)).astype(np.float32)
    n = tf.sum(axis=1, keepdims=True)
    weight = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / n.mean()))
    shard = packing.Shard(docs, idf, n.mean())
    for seed in range(150):
        unused = np.arange(150) != seed
        score = np.where(unused, weight[:, tf[seed] > 0].sum(axis=1), 0)
        got = shard.neighbours(seed, unused)
        assert len(got) == packing.NEIGHBOURS
        assert np.allclose(score[got], np.sort(score)[::-1][: len(got)], rtol=1e-4)


def test_equal_documents_tie_by_place():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 500, 200).astype("<u2") for _ in range(40)]
    docs = docs + docs
    shard = packing.Shard(docs, np.linspace(0.1, 5, 500).astype(np.float32), 200.0)
    got = shard.neighbours(0, np.arange(80) != 0).tolist()
    assert got[0] == 40 and got[2::2] == [d + 40 for d in got[1:-1:2]]


def test_odd_rows(make, odd):
    out = packing.pack(make(odd), keep_ids=True)
    tokens = sum(r.length for r in out.collect())
    assert tokens == sum(len(packing.Tokens(PATH).ids(t or "")) for _, t, *_ in odd)
    assert packing.pack(make([])).count() == 0
