import corpus_pipeline
from pyspark.sql import functions as F

from quillsieve.llm import linededup, mixing, quality, simhash


def passage_docs(make, sample):
    """The sample, two documents with a shared passage as a line, and two copies."""
    passage = " ".join(f"passage{k}" for k in range(55))
    own = lambda i: " ".join(f"own words {i} number{i}x{k}" for k in range(12))
    copy = " ".join(f"copied{k}" for k in range(80))
    more = [(i, f"{own(i)}\n{passage}", "en", "src1") for i in (7000, 7001)] + [(i, copy, "en", "src1") for i in (7002, 7003)]
    return make(sample[:40] + more)


def test_stages_are_what_run_applies(spark, tmp_path, make, sample):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    docs = passage_docs(make, sample)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append(now)
    want = {r.doc_id for r in quality.quality(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept[0].collect()} == want
    passage = " ".join(f"passage{k}" for k in range(55))
    lines = {r.doc_id: r.text for r in kept[1].collect()}
    assert {7000, 7001, 7002} <= want and 7003 in want
    assert passage in lines[7000] and passage not in lines[7001] and "own words 7001" in lines[7001]
    assert 7002 in lines and 7003 not in lines  # a copy has no line left of its own
    gone = {r.doc_id: r.removed_lines for r in linededup.dedup_report(kept[0]).collect()}
    for r in kept[1].collect():
        before = kept[0].filter(F.col("doc_id") == r.doc_id).first().text
        drop = {int(x) for x in gone[r.doc_id].split(",") if x}
        assert r.text == "\n".join(x for i, x in enumerate(before.split("\n")) if i not in drop)
        break
    least = {r.id for r in simhash.near_duplicates(kept[1]).filter("id = component_id").collect()}
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(least)
    copies = {r.doc_id: r.copies for r in mixing.mix_report(kept[2]).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in kept[3].groupBy("doc_id").count().collect()} == copies
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id").collect() == kept[4].groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id").collect()


def test_odd_rows(spark, make, odd):
    now = make(odd)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    now.count()


def shuffled_bytes(df):
    """Bytes that the shuffles of a table's own plan wrote, once it has been collected."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
        kids = node.children()
        return own + sum(walk(kids.apply(i)) for i in range(kids.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_texts_without_copies_are_not_shuffled(spark, tmp_path, make):
    """Where a table is too large to broadcast, only texts that may change or go meet it."""
    own = lambda i: "\n".join(" ".join(f"w{i}x{k}x{j}" for j in range(12)) for k in range(20))
    rows = [(i, own(i)) for i in range(200)]
    shared, copy = "a line that two of the documents have", " ".join(f"copied{k}" for k in range(90))
    rows[7], rows[9] = (7, f"{own(7)}\n{shared}"), (9, f"{shared}\n{own(9)}")
    rows += [(300, copy), (301, copy), (302, copy), (302, copy)]
    make(rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    size = sum(len(t) for _, t in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = linededup.remove_lines(docs, count_col="n_chars", least=1)
        left = {r.doc_id: r.text for r in lines.collect()}
        kept = simhash.keep_one(docs, width=5, exact=True)
        ids = sorted(r.doc_id for r in kept.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left == dict(rows[:200]) | {9: own(9), 300: copy}
    assert ids == [*range(200), 300]
    assert 0 < shuffled_bytes(lines) < size // 4 and 0 < shuffled_bytes(kept) < size // 4
