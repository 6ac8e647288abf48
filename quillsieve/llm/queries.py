"""The operators bound to the tables of the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hosts, linededup, lm, media, mixing, packing, quality, secrets, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if the label of its number says low quality or toxic."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return hosts.judge_urls(_table(spark, sf_dir, "pages"), labels)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_links`` counts all lines elsewhere that match one of the document's; they are counted where they meet, so no pairs are written."""
    return linededup.dedup_report(_table(spark, sf_dir, "documents"), least=1)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents")).drop("copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_warc, op3_packing, op4_secrets, op5_lm, op6_hosts, op7_quality, op8_lines, op9_simhash, op10_mixing)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) >> s) & 31) + 1 AS INT), 1)), '')), '') AS digest FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM b
"""


def _hosts_sql() -> str:
    two = ", ".join(f"'{x}'" for x in hosts.TWO_LABEL_SUFFIXES)
    cut = lambda n: f"array_to_string(string_split(bare, '.')[-{n}:], '.')"
    rho = lambda t: f"(SELECT coalesce(least(0.999, greatest(0.001, sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0))), 0.5) FROM {t})"
    s = lambda t: f"((1 - {rho(t)}) / {rho(t)})"
    mean = lambda t: f"(k + {s(t)} * m) / (n + {s(t)})"
    rule = verdict = "NULL"
    for what, text in sorted(reversed(hosts.RULES), key=lambda r: len(r[1])):
        at, slash, rest = text.partition("/")
        fits = f"((host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{slash}{rest}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    return f"""
WITH pg AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
lb AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM pg LEFT JOIN lb USING (page_id) GROUP BY host),
h AS (SELECT host, n, k, CASE WHEN regexp_matches(bare, '^[0-9.]*$') THEN bare WHEN {cut(2)} IN ({two}) THEN {cut(3)} ELSE {cut(2)} END AS domain FROM h0),
d AS (SELECT domain, sum(n) AS n, sum(k) AS k, CASE WHEN regexp_matches(domain, '^[0-9.]*$') THEN '' WHEN array_to_string(string_split(domain, '.')[-2:], '.') IN ({two}) THEN array_to_string(string_split(domain, '.')[-2:], '.') ELSE string_split(domain, '.')[-1] END AS suffix FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
s1 AS (SELECT *, (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0) FROM s) AS m FROM s),
s2 AS (SELECT suffix, {mean('s1')} AS mean FROM s1),
d1 AS (SELECT d.*, mean AS m FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, {mean('d1')} AS mean FROM d1),
h1 AS (SELECT h.*, mean AS m FROM h JOIN d2 USING (domain)),
h2 AS (SELECT host, {mean('h1')} AS mean, n + {s('h1')} AS total FROM h1),
r AS (SELECT host, mean - {hosts.Z} * sqrt(mean * (1 - mean) / (total + 1)) AS lower FROM h2)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN lower > {hosts.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM pg JOIN r USING (host)
"""


def _mix_sql() -> str:
    weights = f"[{', '.join(f'{w}.0::DOUBLE' for w in mixing.WEIGHTS)}]"

    def fill(table: str, by: str, weight: str, cap: str, total: str, ties: str, out: str) -> str:
        part = f"PARTITION BY {by} " if by else ""
        order = f"{part}ORDER BY CASE WHEN {weight} > 0 THEN {cap} / {weight} ELSE 0 END, {ties}"
        level = f"CASE WHEN sum({weight}) OVER (a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 0 THEN ({total} - coalesce(sum({cap}) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum({weight}) OVER (a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE 0 END"
        return f"(SELECT *, greatest(0, least({cap}, max(level) OVER ({part}) * {weight})) AS {out} FROM (SELECT *, {level} AS level FROM {table} WINDOW a AS ({order})))"

    return f"""
WITH b AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, (CAST(CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496::DOUBLE AS u FROM documents),
c AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(log2(size + 0.5::DOUBLE)) AS INT) ELSE 0 END AS class FROM b),
k AS (SELECT source, class, CAST(sum(size) AS DOUBLE) AS class_size FROM c GROUP BY 1, 2),
s AS (SELECT source, sum(class_size) AS source_size FROM k GROUP BY 1),
s1 AS (SELECT *, {weights}[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, sum(source_size) OVER () AS total, {float(mixing.MAX_REPEATS)}::DOUBLE * source_size AS cap FROM s),
s2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM {fill('s1', '', 'weight', 'cap', 'total', 'source', 'target')}),
s3 AS (SELECT source, source_size, target, whole, target - whole * source_size AS rest FROM s2),
k1 AS (SELECT k.*, s3.* EXCLUDE (source), (1 + class / 8.0::DOUBLE) * class_size AS w FROM k JOIN s3 ON k.source IS NOT DISTINCT FROM s3.source),
k2 AS (SELECT *, CASE WHEN class_size > 0 THEN share / class_size ELSE 0 END AS p FROM {fill('k1', 'source', 'w', 'class_size', 'rest', 'class', 'share')}),
r AS (SELECT doc_id, c.source, size, source_size, target, whole, rest, p, CASE WHEN p >= 1 THEN 0 WHEN p <= 0 THEN 1 ELSE u * (1 - p) / (u * (1 - p) + p * (1 - u)) END AS rank FROM c JOIN k2 ON c.class = k2.class AND c.source IS NOT DISTINCT FROM k2.source),
q AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST((whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM q
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the operator with its full result."""
    return {"op2_warc": _WARC_SQL, "op6_hosts": _hosts_sql(), "op10_mixing": _mix_sql()}
