import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillsieve.llm import lm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    count = Counter(t for (_, text, *_), h in zip(rows, held, strict=True) if not h for t in tokens(text))
    n, v = sum(count.values()), len(count)
    out = []
    for (i, text, *_), h in zip(rows, held, strict=True):
        t = tokens(text)
        out.append((i, h, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)))
    return out


@pytest.mark.parametrize("counted", [1 << 18, 60])
def test_base_scores(make, odd, sample, monkeypatch, counted):
    """With few counts sent to the workers, most come by the join."""
    monkeypatch.setattr(lm, "COUNTED", counted)
    monkeypatch.setattr(lm.frequent, "__defaults__", (counted,))
    rows = odd + sample
    got = lm.score(make(rows, ["SCORE", "h", "row"])).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 4))
    assert sorted(map(key, got)) == sorted(map(key, brute(rows)))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    mine = [(r.base_score, r.score) for r in got if r.held_out]
    assert sum(s for _, s in mine) > sum(b for b, _ in mine)  # better than single words on unseen texts


def test_probabilities_sum_to_one(make, sample):
    for p in lm_tables(make(sample)):
        assert p.sum() == pytest.approx(1.0, abs=1e-3)


def lm_tables(train):
    """P(unit | context) for some contexts, from the tables that scoring uses."""
    made = {}
    keep = lm._score

    def spy(table, within, classes, *more):
        made["t"] = (table, within, classes)
        return keep(table, within, classes, *more)

    lm._score = spy
    try:
        lm.score(train).count()
    finally:
        lm._score = keep
    table, within, classes = made["t"]
    units = np.arange(lm.UNITS)
    for one, two in ((0, 1), (3, 2), (lm._BOS, lm._BOS), (lm.UNITS - 1, 5)):
        f1, f2, g = lm.feature(np.array([one]), lm.FEATURES), lm.feature(np.array([two]), lm.FEATURES), lm.feature(np.array([one]), lm.GROUPS)
        filled = np.isin(np.arange(lm.CLASSES), classes)
        p = np.exp(table[f1[0], f2[0], classes[units]] + within[g[0], units])
        rest = np.exp(table[f1[0], f2[0]])[~filled].sum()
        yield np.r_[p, rest]


def test_hashed_units_share_all_their_probability():
    n, words = 37.0, 5
    counts = [20, 10, 4, 2, 1]
    share = math.log10(n + lm.ALPHA * (words + 1))
    total = sum(10 ** (math.log10(c + lm.ALPHA) - share) for c in [*counts, 0])
    assert total == pytest.approx(1.0)


def test_learns_order(make):
    """A strict alternation is predicted far better than by single words."""
    rows = [(i, "red green blue " * 20) for i in range(1, 120)]
    got = lm.score(make(rows)).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.score / r.n_tokens > 0.35 * r.base_score / r.n_tokens for r in held)


def test_empty(make):
    assert lm.score(make([])).count() == 0
    assert lm.score(make([(1, None)])).first().n_tokens == 1


def random_shard(seed=3, contexts=6):
    """A shard with weights for some pairs, and tables as scoring uses them."""
    rng = np.random.default_rng(seed)
    classes = rng.integers(0, lm.CLASSES, lm.UNITS)
    classes[: lm.CLASSES] = np.arange(lm.CLASSES)
    within = rng.normal(size=(lm.GROUPS, lm.UNITS))
    for c in range(lm.CLASSES):
        within[:, classes == c] -= np.log(np.exp(within[:, classes == c]).sum(axis=1, keepdims=True))
    table = lm._log_softmax(rng.normal(size=(lm.FEATURES, lm.FEATURES, lm.CLASSES)))
    ctx = np.sort(rng.choice(lm.HEAD, contexts, replace=False))
    cells = [(c, u, rng.normal()) for c in ctx for u in rng.choice(lm.UNITS + lm.CLASSES, 50, replace=False)]
    return lm.Shard(np.array(cells, lm._CELL), within, classes), table, within, classes, ctx


def test_word_weights_keep_probabilities_whole():
    shard, table, within, classes, ctx = random_shard()
    units = np.arange(lm.UNITS)
    for c in [*ctx, lm.HEAD + 5, lm._START]:  # the last two have no weights
        p = np.exp(lm.log_p(shard, table, within, classes, np.full(lm.UNITS, c), np.full(lm.UNITS, 7, np.uint8), units))
        assert p.sum() == pytest.approx(1.0, abs=1e-3)


def test_fitted_weights_balance_their_prior():
    """At the optimum, observed less expected counts are the prior's pull."""
    rng = np.random.default_rng(5)
    group = np.repeat(np.arange(40), 5)
    base = rng.dirichlet(np.ones(8), 40)[:, :5].reshape(-1)
    n = rng.integers(1, 30, 200).astype(float)
    x = lm.fit_words(n, base, group, 0.1, rounds=600)
    p = base * np.exp(x)
    z = 1 - np.bincount(group, base) + np.bincount(group, p)
    assert np.abs(n - np.bincount(group, n)[group] * p / z[group] - 0.1 * x).max() < 0.5


def test_pairs_of_any_number_of_words_are_learned(make):
    """Each of many words has a follower of its own; most lie outside the values of f1."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"k{x} v{x}" for x in rng.integers(0, 2000, 100))) for i in range(1, 400)]
    held = [r for r in lm.score(make(rows)).collect() if r.held_out]
    # about half of the tokens can be foretold
    assert held and all(r.score > 0.75 * r.base_score for r in held)


@pytest.mark.parametrize("most", [1 << 20, 512])
def test_shards_change_no_score(make, sample, monkeypatch, most):
    """Many small shards, with copies of those that hold frequent words, give what few give."""
    rows = sample[:150]
    want = {r.doc_id: r.score for r in lm.score(make(rows)).collect()}
    monkeypatch.setattr(lm, "SHARD", most)
    got = {r.doc_id: r.score for r in lm.score(make(rows)).collect()}
    assert got == pytest.approx(want, rel=1e-3)
