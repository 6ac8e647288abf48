import random
import re
from functools import partial

from quillsieve.llm import linededup, simhash


def tokens(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", low))


def brute(rows):
    """(id, text) to (removed lines, links, class) for distinct rows with ids."""
    lines = [((i, k), tokens(x)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    lines = sorted((p, s) for p, s in lines if len(s) >= 5)
    out = {i: ([], 0, i) for i, _ in rows}
    for p, s in lines:
        match = [q for q, r in lines if q != p and 5 * len(s & r) >= 4 * len(s | r)]
        gone, n, c = out[p[0]]
        if match and min(match) < p:
            gone.append(p[1])
        out[p[0]] = (gone, n + len(match), min([c, *[q[0] for q in match]]))
    return out


def fixture(seed=0):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rare = [f"r{i}" for i in range(3000)]
    base = [[rng.choice(common if rng.random() < 0.4 else rare) for _ in range(rng.randint(3, 30))] for _ in range(60)]
    rows = []
    for d in range(80):
        text = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 5)):
                line[rng.randrange(len(line))] = rng.choice(common + rare)
            rng.shuffle(line)
            text.append(" ".join(line))
        rows.append((d, "\n".join(text)))
    return rows


def test_matches_brute_force(make, monkeypatch):
    rows = fixture() + [(100, None), (101, ""), (102, "A b C d e\n\na B c D E\nf"), (103, "a b c d e"), (104, "a b c d e x y")]
    want = brute(rows)
    for pairs in (1 << 20, 16):  # small blocks of pairs give the same
        monkeypatch.setattr(linededup, "PAIRS", pairs)
        got = {r.doc_id: r for r in linededup.dedup_report(make(rows, ["th", "LINE", "id"])).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            gone, links, least = want[i]
            r = got[i]
            assert (r.n_lines, r.n_removed, r.n_links, r.class_id, r.removed_lines) == (len((t or "").split("\n")), len(gone), links, least, ",".join(map(str, gone))), i


def brute_all(rows):
    """Removed lines of distinct rows with ids, every line with a word compared."""
    lines = sorted(((i, k), s) for i, t in rows for k, x in enumerate((t or "").split("\n")) if (s := tokens(x)))
    out = {i: [] for i, _ in rows}
    for p, s in lines:
        if any(q < p and 5 * len(s & r) >= 4 * len(s | r) for q, r in lines):
            out[p[0]].append(p[1])
    return out


def test_short_lines_and_lines_of_one_word(make):
    """Copies of short lines, four words against five, and lines in scripts without spaces."""
    zh = "这是一个没有空格的很长的句子" * 5
    rows = fixture(2) + [(100, f"Ietzte.\nStteen Erachtz.\n\n{zh}"), (101, f"ietzte.\n\n{zh}\nown"), (102, "q w e r\nq w e r t\nq w e\n \n"), (103, "a a a a a a b c d\nd c b a"), (104, None)]
    want = brute_all(rows)
    assert want[101] == [0, 2] and want[102] == [1] and want[103] == [1]
    got = {r.doc_id: r for r in linededup.dedup_report(make(rows), least=1).collect()}
    assert {i: r.removed_lines for i, r in got.items()} == {i: ",".join(map(str, sorted(x))) for i, x in want.items()}
    assert sum(r.n_removed for r in got.values()) > sum(r.n_removed for r in linededup.dedup_report(make(rows)).collect())


def test_query_and_stage_compare_short_lines(spark, tmp_path, make):
    import corpus_pipeline

    from quillsieve.llm import queries

    docs = make([(1, "first of all\nshort line"), (2, "second of all\nshort line")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.removed_lines for r in queries.op8_lines(spark, str(tmp_path)).collect()} == {1: "", 2: "1"}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}[2] == "second of all"


def test_removal(make):
    rows = fixture(1)
    want = brute(rows)
    df = make(rows)
    out = linededup.remove_lines(df, count_col="n_chars")
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    for i, t in rows:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i][0])
        if want[i][0] and not left.split():
            assert i not in got
        else:
            assert got[i] == (left, len(left))


def test_odd_rows(make, odd):
    out = linededup.remove_lines(make(odd))
    assert {r.doc_id for r in out.collect()} <= {i for i, *_ in odd}
    assert linededup.dedup_report(make(odd)).count() == len(odd)
    assert linededup.dedup_report(make([])).count() == 0 and linededup.remove_lines(make([])).count() == 0


def test_copied_passage_is_left_once(make):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own line number {i} with words {i} here\n{passage}") for i in range(6)]
    got = {r.doc_id: r.text for r in linededup.remove_lines(make(rows)).collect()}
    assert [i for i in range(6) if passage in got[i]] == [0]


SMALL = {"PAIRS": 16, "LONG_RUN": 4, "BLOCK": 2, "RUN_ROWS": 24, "BUCKET_ROWS": 64}


def near_copies(n, words=40, seed=3):
    """Lines that differ from one another in a word or two, each in a document of its own."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for d in range(n):
        line = list(base)
        line[rng.randrange(words)] = f"own{d}"
        rows.append((d, " ".join(line)))
    return rows


def test_blocks_and_rounds_lose_nothing(make, monkeypatch):
    """Long runs, runs dealt out in blocks and later rounds give the same lines."""
    rows = fixture(4) + [(1000 + i, t) for i, t in near_copies(40)]
    want = {i: ",".join(map(str, sorted(x))) for i, x in brute_all(rows).items()}
    for sizes in ({}, SMALL):
        for k, v in sizes.items():
            monkeypatch.setattr(linededup, k, v)
        got = linededup.dedup_report(make(rows), least=1, whole=False).collect()
        assert {r.doc_id: r.removed_lines for r in got} == want
        # every later line has one link with two ends
        assert sum(r.n_links for r in got) == 2 * sum(r.n_removed for r in got) and all(r.n_links >= r.n_removed for r in got)


def test_components_join_what_earliest_matches_leave_apart(spark, make, monkeypatch):
    """A matches B and C matches B, but A and C do not match: one group all the same."""
    w = [f"w{i}" for i in range(100)]
    a, b, c = w[:90], w[5:95], w[10:]  # 85 of 95 words in common, and 80 of 100
    apart = [f"z{i}" for i in range(100)]
    far = [apart[:90], apart[8:98], apart[16:] + ["y"] * 6]  # 82 of 98, then 74 of 107
    rows = [(1, " ".join(a)), (3, " ".join(b)), (2, " ".join(c)), (10, " ".join(far[0])), (12, " ".join(far[1])), (11, " ".join(far[2]))]
    rows += [(100 + i, t) for i, t in near_copies(30)]
    for sizes in ({}, SMALL):
        for k, v in sizes.items():
            monkeypatch.setattr(linededup, k, v)
        df = linededup._rows(make(rows), "doc_id", "text")
        join = linededup.Join(df, partial(linededup.shingles, width=1))
        first = {r["rank"]: r["first"].id for r in join.classes.collect()}
        groups = {}
        label = {r.node: r.label for r in join.components(simhash.components).collect()}
        for rank, i in first.items():
            groups.setdefault(label.get(rank, rank), set()).add(i)
        assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [10, 11, 12], list(range(100, 130))]


def test_candidates_grow_with_the_lines(spark, make):
    """Rows between the stages are in proportion to a group of near copies, not to its pairs."""
    counts = []
    for n in (200, 400):
        join = linededup.Join(linededup._rows(make(near_copies(n)), "doc_id", "text"), partial(linededup.tokenize, least=1))
        counts.append((join.candidates(linededup.FIRST).count(), join.matches().count()))
    assert counts[0][1] == 199 and counts[1][1] == 399
    assert counts[1][0] < 2.5 * counts[0][0] < 2.5 * 200 * 10


def test_a_task_whose_rows_are_in_no_wanted_run():
    """It gives no index rows, alone or beside a batch that has some."""
    import numpy as np
    import pyarrow as pa

    def batch(run):
        one = {"rank": [1], "parity": [2], "parity2": [3], "n": [9], "ask": [False], "quiet": [False], "prefix": [np.array([run], "<u4").tobytes()]}
        return pa.RecordBatch.from_pydict(one)

    wanted = np.zeros((1 << linededup.RUN_BITS) // 64, np.uint64)
    wanted[0] = 1 << 5
    rows = lambda *runs: [np.frombuffer(x, linededup.ROW) for b in linededup._index_rows(4, {}, wanted, False)(map(batch, runs)) for x in b.column("rows").to_pylist()]
    assert rows(6) == [] and rows(6, 7) == []
    assert [r["run"].tolist() for r in rows(6, 5, 7)] == [[5]]


def test_query_counts_every_link(spark, tmp_path, make, monkeypatch):
    """The query's links are those of a brute force over all lines; a group dealt out in blocks, long and hot runs give the same."""
    from quillsieve.llm import queries

    rows = fixture(6) + [(1000 + i, t) for i, t in near_copies(40)] + [(2000, None), (2001, near_copies(3)[2][1])]
    lines = [(i, s) for i, t in rows for x in (t or "").split("\n") if (s := tokens(x))]
    want = {i: 0 for i, _ in rows}
    for p, (i, s) in enumerate(lines):
        want[i] += sum(p != q and 5 * len(s & r) >= 4 * len(s | r) for q, (_, r) in enumerate(lines))
    gone = {i: ",".join(map(str, sorted(x))) for i, x in brute_all(rows).items()}
    assert max(want.values()) >= 40
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    for sizes in ({}, SMALL | {"GROUP": 7, "SHARED": 16}):
        for k, v in sizes.items():
            monkeypatch.setattr(linededup, k, v)
        got = queries.op8_lines(spark, str(tmp_path)).collect()
        assert {r.doc_id: r.removed_lines for r in got} == gone
        assert {r.doc_id: r.n_links for r in got} == want


def test_long_sets_are_told_apart_before_they_are_verified(spark, make):
    """Long lines that share a rare word are no likely pairs; long near copies are."""
    long = [(i, " ".join([f"rare{i // 2}", *[f"l{i}x{k}" for k in range(900 + 100 * (i % 2))]])) for i in range(12)]
    base = [f"b{k}" for k in range(1000)]
    near = [(100, " ".join(base)), (101, " ".join(base[90:] + [f"n{k}" for k in range(60)])), (102, " ".join(base[:850])), (103, " ".join(base[:700]))]
    join = linededup.Join(linededup._rows(make(long + near), "doc_id", "text"), partial(linededup.tokenize, least=1))
    name = {r["rank"]: r["first"].id for r in join.classes.collect()}
    every = [(x, y) for x in name for y in name if y < x]
    pairs = spark.createDataFrame(every, "x long, y long")
    likely = {(name[r.x], name[r.y]) for r in join.likely(pairs).collect()}
    sets = {i: tokens(t) for i, t in long + near}
    want = {(name[x], name[y]) for x, y in every if 5 * len(sets[name[x]] & sets[name[y]]) >= 4 * len(sets[name[x]] | sets[name[y]])}
    assert {(101, 100), (102, 100)} <= want <= likely
    assert not [p for p in likely if p[0] < 100 or p[1] < 100]


def test_query_keeps_no_more_of_a_line_than_it_compares(spark, tmp_path, make, monkeypatch):
    """Counted links need no sketches; token sets are made of the lines in question alone; groups compared together stay apart."""
    from quillsieve.llm import queries

    rows = fixture(7) + [(1000 + i, t) for i, t in near_copies(20)] + [(3000, None), (3001, "\n\n"), (3002, "own words\nnone of the others")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    tables = {}
    keep = linededup.scratch
    monkeypatch.setattr(linededup, "scratch", lambda df, name, *a: tables.setdefault(name, df.columns) and keep(df, name, *a))
    got = []
    for n in (1, 5, 128):
        monkeypatch.setattr(linededup, "TOGETHER", n)
        got.append(sorted((r.doc_id, r.n_lines, r.n_links, r.removed_lines) for r in queries.op8_lines(spark, str(tmp_path)).collect()))
    assert got[0] == got[1] == got[2]
    assert {i: n for i, n, *_ in got[0]} == {i: len((t or "").split("\n")) for i, t in rows}
    assert {i: r for i, *_, r in got[0]} == {i: ",".join(map(str, sorted(x))) for i, x in brute_all(rows).items()}
    assert not {"p0", "wide"} & {*tables["lines"], *tables["line-classes"]}


def test_lines_at_named_places():
    import numpy as np

    texts, doc = [b"a b\nc\n\nd", b"", b"e\nf g"], np.array([5, -7, 1 << 62])
    for want, own, line in ((b"c", 5, 1), (b"d", 5, 3), (b"", -7, 0), (b"f g", 1 << 62, 1)):
        places = np.zeros((1 << linededup.SIEVE_BITS) // 64, np.uint64)
        slot = (own ^ line * linededup._STEP) & ((1 << linededup.SIEVE_BITS) - 1)
        places[slot >> 6] = np.uint64(1 << (slot & 63))
        assert linededup._lines_at(places, texts, doc) == [want]
    assert linededup._lines_at(places, [], doc[:0]) == []
