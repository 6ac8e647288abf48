import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quillsieve.llm import mixing


def targets(sizes, weights=(1, 2, 3)):
    """Water filling by repeated resharing; None is last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: 3 * sizes[s] for s in full}
        open_ -= full
    return out


def u(i):
    return (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def brute(rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    by = defaultdict(list)
    for i, _, _, s in rows:
        by[s].append(i)
    sizes = {s: sum(size[i] for i in v) for s, v in by.items()}
    goal, taken = targets(sizes), {}
    for s, v in by.items():
        whole = math.floor(goal[s] / sizes[s]) if sizes[s] else 0
        rest = goal[s] - whole * sizes[s]
        k = {i: math.floor(math.log2(size[i] + 0.5)) if size[i] else 0 for i in v}
        cls = defaultdict(int)
        for i in v:
            cls[k[i]] += size[i]
        lo, hi = 0.0, 1e12
        for _ in range(300):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(n, mid * (1 + c / 8) * n) for c, n in cls.items()) < rest else (lo, mid)
        p = {c: min(1.0, hi * (1 + c / 8)) for c in cls}

        def rank(i, p=p, k=k):
            q = p[k[i]]
            return 0.0 if q >= 1 - 1e-12 else u(i) * (1 - q) / (u(i) * (1 - q) + q * (1 - u(i)))

        upto = 0
        for i in sorted(v, key=lambda i: (rank(i), i)):
            upto += size[i]
            extra = rest > 0 and 2 * upto - size[i] <= 2 * rest
            taken[i] = size[i] * (whole + extra)
    return size, sizes, goal, taken


def test_against_brute_force(make, sample):
    rows = [(i, t, g, s) for i, t, g, s in sample] + [(900 + k, "w " * (k + 1), "en", None) for k in range(9)] + [(950, "a b", "en", "tiny"), (951, None, "en", "zero"), (952, "", "en", "zero")]
    got = {r.doc_id: r for r in mixing.mix_report(make(rows, ["SIZE", "class", "target"])).collect()}
    size, sizes, goal, taken = brute(rows)
    for i, _, _, s in rows:
        r = got[i]
        assert (r.size, r.source_size, r.taken) == (size[i], sizes[s], taken[i]), i
        assert abs(r.target - goal[s]) < 1e-6 * max(1, goal[s]) and r.taken <= 3 * r.size
    for s in sizes:
        total = sum(r.taken for i, r in got.items() if next(x[3] for x in rows if x[0] == i) == s)
        assert abs(total - goal[s]) <= max(size[i] for i, *x in rows if x[2] == s) / 2 + 1


def test_reruns_agree_and_copies(make, sample):
    df = make(sample)
    a, b = (sorted(map(tuple, mixing.mix_report(df.repartition(n)).collect())) for n in (2, 5))
    assert a == b
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n == {x[0]: x[5] for x in a if x[5]}


def test_inclusion_rises_with_length(spark):
    df = spark.range(40000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(2 + 60 * (id % 2) as int))").alias("text"), F.expr("if(id % 5 = 0, 'a', 'b')").alias("source"))
    r = mixing.mix_report(df).withColumn("src", F.col("doc_id") % 5 == 0).filter("src = false").groupBy("size").agg(F.avg("copies").alias("c")).collect()
    short, long = (next(x.c for x in r if x.size == s) for s in (2, 62))
    assert long > short * 1.02


def test_odd_rows(make, odd):
    assert mixing.mix_report(make(odd)).count() == len(odd)
    assert mixing.mix_report(make([])).count() == 0 and mixing.apply_mix(make([])).count() == 0
    assert [r.taken for r in mixing.mix_report(make([(1, None), (2, " ")])).collect()] == [0, 0]
