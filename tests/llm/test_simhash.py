import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillsieve.llm import common, simhash


def reference(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps):
    """Component of each row by brute force."""
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_fingerprints_and_components(make, odd, sample):
    near = [(5000 + k, sample[3][1] + f" {k}") for k in range(12)] + [(6000, None), (6001, "  ")]
    rows = odd + sample + near
    got = simhash.near_duplicates(make(rows, ["FP", "label"])).collect()
    fps = [reference(t) for _, t, *_ in rows]
    want = Counter(zip([i for i, *_ in rows], fps, groups([i for i, *_ in rows], fps), strict=True))
    assert Counter((r.id, r.fp & (2**64 - 1), r.component_id) for r in got) == want


@pytest.mark.parametrize("run", [2, 64])
def test_links_connect_what_brute_force_connects(spark, run):
    """With small runs nearly every variant is hot, and the exact signatures must find all links."""
    rng = random.Random(run)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            for b in rng.sample(range(64), rng.choice([1, 1, 2, 3])):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.array(x, np.uint64).view(np.int64)) for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), run)
    rows = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in rows)
    got = {r.node & (2**64 - 1): r.label for r in simhash.components(links).collect()}
    mine = {}
    for x, own in zip(fps, signed, strict=True):
        mine.setdefault(got.get(x, own), set()).add(x)  # a component's least node is its label
    want = {}
    for x, g in zip(fps, groups(list(range(len(fps))), fps), strict=True):
        want.setdefault(g, set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(-40, 400)], "a long, b long")
    out = simhash.components(links).agg(F.min("label"), F.max("label"), F.count("node")).first()
    assert tuple(out) == (-40, -40, 440)


def test_stage_finds_all_near_copies(spark, make, odd, sample):
    """The pipeline's stage keeps what a brute force over 5-word shingle sets keeps."""
    import corpus_pipeline

    rng = random.Random(5)
    rows = [(i, t) for i, t, *_ in sample[:60]]
    for k in range(40):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 200))]
        rows.append((10_000 + 10 * k, " ".join(w)))
        for c in range(1, 4):  # some above, some below the similarity
            v = list(w)
            for _ in range(rng.randint(1, 1 + len(w) // 30)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(4000)}"
            rows.append((10_000 + 10 * k + c, " ".join(v)))
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split(" ")
        w = " ".join(w).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    label = list(range(len(rows)))
    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                linked += sets[i] != sets[j]
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    assert linked > 30
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        least[g] = min(i, least.get(g, i))
    got = corpus_pipeline.near_dedup(spark, make(rows), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(least.values())
    got = corpus_pipeline.near_dedup(spark, make(odd), "").collect()  # without words: one; repeated rows: once
    assert len([1 for r in got if not (r.text or "").split()]) == 1 and [r.doc_id for r in got].count(8) == 1
    assert corpus_pipeline.near_dedup(spark, make([]), "").count() == 0


def test_keep_one(make, odd):
    df = make(odd + [(20, "same words here and more"), (19, "same words here and more"), (None, "same words here and more")])
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert 19 in ids and 20 not in ids and ids.count(8) <= 1
    assert len([1 for r in out.collect() if not (r.text or "").split()]) == 1
    assert simhash.keep_one(make([])).count() == 0 and simhash.near_duplicates(make([])).count() == 0


def test_no_broadcast_beyond_the_bound(spark, make, sample, monkeypatch):
    """Sides of joins that grow with the documents are not broadcast by the size of their compressed files."""
    plans = []

    def watched(df, name, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.scratch(df, name, *rest)

    small = spark.range(5).withColumnRenamed("id", "k").withColumn("v", F.lit("v"))
    small = common.scratch(small, "small")
    joined = common.bounded_join(spark.range(50).withColumn("k", F.col("id") % 5), small, ["k"], limit=0)
    assert joined.count() == 50
    plans.append(joined._jdf.queryExecution().executedPlan().toString())
    base = " ".join(f"w{i}" for i in range(900))
    rows = sample[:50] + [(9000 + i, f"{base} own{i}") for i in range(8)]
    first = simhash.near_duplicates(make(rows)).collect()
    want = sorted((r.id, r.component_id) for r in first)
    assert len({r.fp for r in first}) > len({r.component_id for r in first})  # links of different fingerprints
    monkeypatch.setattr(simhash, "scratch", watched)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0, raising=False)
    out = simhash.near_duplicates(make(rows))
    assert sorted((r.id, r.component_id) for r in out.collect()) == want
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not any("BroadcastHashJoin" in p for p in plans)


def test_stage_links_by_fingerprints_first(spark, make, monkeypatch):
    """The pipeline's stage makes fingerprints of 5-word shingles; links that hold on the sets go to the exact join."""
    import corpus_pipeline

    widths, found = [], []
    plain, links = simhash.fingerprints, simhash.near_links

    def fingerprints(docs, id_col="doc_id", text_col="text", width=3):
        widths.append(width)
        return plain(docs, id_col, text_col, width)

    def near_links(*args):
        found.append(links(*args))
        # read now: the table goes once its readers have run
        found[-1].rows = found[-1].count()
        return found[-1]

    monkeypatch.setattr(simhash, "fingerprints", fingerprints)
    monkeypatch.setattr(simhash, "near_links", near_links)
    base = " ".join(f"w{i}" for i in range(900))
    rows = [(i, f"{base} own{i}") for i in range(8)] + [(20, "something else"), (21, "Something else"), (22, None)]
    got = corpus_pipeline.near_dedup(spark, make(rows), "").collect()
    assert sorted(r.doc_id for r in got) == [0, 20, 22]
    assert widths == [5] and found[0].rows > 0
