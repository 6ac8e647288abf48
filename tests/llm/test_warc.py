import base64
import hashlib

from pyspark.sql import functions as F

from quillsieve.llm import warc


def _digest(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_round_trip(spark):
    rows = [(1, "http://www.a.org/x", "same"), (2, "http://b.a.org/y?q", "same"), (3, None, None), (4, "no scheme", ""), (5, "http://a.org/\tü\n", "é" * 9000), (5, "http://a.org/\tü\n", "é" * 9000), (None, "http://z.net/", "same"), (None, None, "alone")]
    rows += [(100 + i, f"http://h{i % 7}.example.com/p/{i}", f"<html>{i % 40}</html>") for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("KEY", F.lit(1)).withColumn("first", F.lit(2)).repartition(5)
    got = warc.archive_and_read(df).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and f != i
        want.append((str(i), len(p), _digest(p), "revisit" if again else "response", str(f if again else None)))
    assert sorted(want) == sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got)


def test_lookup_of_some_keys_and_payload(spark):
    df = spark.createDataFrame([(i, f"http://x.org/{i}", f"body {i}") for i in range(1200)], "page_id long, url string, html string")
    manifest = warc.write_archives(df)
    keys = df.filter("page_id % 100 = 7").select(warc.surt(F.col("url")).alias("key"), "page_id").union(spark.createDataFrame([("nobody", 1)], "key string, page_id long"))
    got = {r.page_id: bytes(r.payload) for r in warc.lookup(manifest, keys, with_payload=True).collect()}
    assert got == {i: f"body {i}".encode() for i in range(7, 1200, 100)}
    assert manifest.agg(F.sum("n_records")).first()[0] == 1200


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "v", "abcdef"), (4, "v", "abcdef")], "page_id long, url string, html string")
    m = warc.write_archives(df, least_bytes=3)
    got = {r.page_id: r.record_type for r in warc.lookup(m, df.select(warc.surt(F.col("url")).alias("key"), "page_id")).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_surt_and_empty(spark):
    df = spark.createDataFrame([("http://www.A.org/x?y",)], "url string")
    assert df.select(warc.surt(F.col("url"))).first()[0] == "org,a,www)/x?y"
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
