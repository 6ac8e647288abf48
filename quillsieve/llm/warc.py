"""WARC archives with a two-level capture index.

``write_archives`` lays captures out in order of their reversed-host key over
one archive file for each task.  Beside every archive it writes an index of
sorted lines in compressed blocks, and a sparse directory with the first key
and the byte range of each block.  ``lookup`` routes keys to an archive by the
first keys of the archives, binary-searches the sparse directory, reads one
block, binary-searches its lines, and reads just the record's byte range.

Files go to the shared folder through ``pyarrow.fs`` under names that hold the
task attempt, so a task that runs again leaves complete files of its own, and
only files of attempts that ended well are in the manifest.  The manifest has
one row for each range partition, whose number is ``spark.sql.shuffle.partitions``
at most: that bounds what is sent to the driver and to the tasks.

Defined results: a null payload is empty, a null url an empty key; of equal
payloads of at least ``least_bytes`` the least id is the response and the rest
are revisits; repeated rows of that id are responses as well; rows without an
id are revisits if an equal payload has an id, else responses; every capture is
returned once, also where key and id repeat; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, bounded_join, fresh_path, pick, scratch

LINES = 500  #: index lines in a block
LEVEL = 3  #: of compression
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:capture:"


def surt(url: Column) -> Column:
    """Reversed-host key: ``http://www.a.org/x`` gives ``org,a,www)/x``; no scheme: the url itself."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.instr(u, "://") > 0, F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(u)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str, page: int | None, payload: bytes, refers: int | None, revisit: bool) -> bytes:
    """One gzip member with a response record, or a revisit record without its payload."""
    target = urllib.parse.quote(url or "", safe="/:?#[]@!$&'()*+,;=%~-._")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <{ID}{'' if page is None else page}>", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """Headers and payload of a record; raises where lengths or digests are wrong."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = h["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError("a payload's digest or length is wrong")
    number = lambda x: int(x.strip("<>").removeprefix(ID)) if x.strip("<>") != ID else None
    return {"page_id": number(h["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, "payload": payload if kind == "response" else None, "url": h["WARC-Target-URI"]}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives, indexes and directories; returns the manifest, one row for each archive."""
    spark = pages.sparkSession
    bound_arrow(spark)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pick(pages, page_id=id_col, url=url_col, html=payload_col).withColumn("html", payload)
    rows = rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("sha", F.sha1("html"))
    firsts = rows.filter(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = scratch(firsts.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("sha", "first"), "warc-firsts")
    placed = bounded_join(rows, firsts, ["sha"])
    placed = placed.select("page_id", F.coalesce("url", F.lit("")).alias("url"), surt(F.col("url")).alias("key"), "html", "first", (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).alias("again"))
    out_dir = fresh_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        stem = f"{out_dir}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        out = index = None
        at = n = 0
        lines: list[bytes] = []
        directory: list[list] = []
        first = None

        def block() -> None:
            z = zlib.compress(b"\n".join(lines), LEVEL)
            directory.append([json.loads(lines[0])[:2], index.tell(), len(z)])
            index.write(z)
            lines.clear()

        for b in batches:
            for r in zip(*[b.column(c) for c in ("page_id", "url", "key", "html", "first", "again")], strict=True):
                page, url, key, first_id, again = (r[k].as_py() for k in (0, 1, 2, 4, 5))
                if out is None:
                    system, path = _open(stem)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out, index = system.open_output_stream(f"{path}.warc.gz", compression=None), system.open_output_stream(f"{path}.cdx", compression=None)
                    first = (key, page)
                member = record(url, page, r[3].as_buffer().to_pybytes(), first_id, again)
                out.write(member)
                lines.append(json.dumps([key, page, at, len(member)]).encode())
                at += len(member)
                n += 1
                if len(lines) == LINES:
                    block()
        if out is not None:
            if lines:
                block()
            out.close()
            index.close()
            with system.open_output_stream(f"{path}.idx", compression=None) as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_pylist([{"part": ctx.partitionId(), "stem": stem, "first_key": first[0], "first_id": first[1], "n_records": n, "n_blocks": len(directory), "n_bytes": at}], pa.schema([("part", pa.int64()), ("stem", pa.string()), ("first_key", pa.string()), ("first_id", pa.int64()), ("n_records", pa.int64()), ("n_blocks", pa.int64()), ("n_bytes", pa.int64())]))

    spread = placed.repartitionByRange(F.col("key"), F.col("page_id")).sortWithinPartitions("key", "page_id")
    return scratch(spread.mapInArrow(write, "part long, stem string, first_key string, first_id long, n_records long, n_blocks long, n_bytes long"), "warc-manifest")


def _order(key: str, page: int | None) -> tuple:
    """Order of Spark's sort: by UTF-8 bytes, null ids first."""
    return key.encode(), page is not None, page or 0


class Archive:
    """Random access to one archive through its directory and index blocks."""

    def __init__(self, stem: str):
        system, path = _open(stem)
        with system.open_input_stream(f"{path}.idx") as f:
            self.directory = json.loads(f.read())
        self.firsts = [_order(*x[0]) for x in self.directory]
        self.index, self.data = system.open_input_file(f"{path}.cdx"), system.open_input_file(f"{path}.warc.gz")
        self.at, self.lines = -1, []

    def block(self, k: int) -> list:
        if k != self.at:
            _, offset, length = self.directory[k]
            got = [json.loads(x) for x in zlib.decompress(self.index.read_at(length, offset)).split(b"\n")]
            self.at, self.lines, self.keys = k, got, [_order(x[0], x[1]) for x in got]
        return self.lines

    def find(self, key: str, page: int | None) -> Iterator[dict]:
        want = _order(key, page)
        k = max(0, bisect.bisect_left(self.firsts, want) - 1)  # equal keys may begin in the block before
        while k < len(self.directory) and self.firsts[k] <= want:
            lines = self.block(k)
            for i in range(bisect.bisect_left(self.keys, want), bisect.bisect_right(self.keys, want)):
                yield parse(self.data.read_at(lines[i][3], lines[i][2]))
            k += 1

    def close(self) -> None:
        self.index.close()
        self.data.close()


def lookup(manifest: DataFrame, keys: DataFrame, with_payload: bool = False) -> DataFrame:
    """All captures of the given (key, page_id) rows, found by the two-level index.

    ``keys`` are made distinct.  Equal keys and ids may fall on both sides of an
    archive's edge, so a key is looked up in every archive that can hold it.
    """
    bound_arrow(manifest.sparkSession)
    parts = sorted((_order(r["first_key"], r["first_id"]), r["part"], r["stem"]) for r in manifest.select("first_key", "first_id", "part", "stem").collect())
    starts, stems = [p[0] for p in parts], [p[2] for p in parts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [])
            for k, p in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                want = _order(k, p)
                for i in range(max(0, bisect.bisect_left(starts, want) - 1), bisect.bisect_right(starts, want)):
                    for o, x in zip(out, (k, p, i), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["key", "page_id", "at"])

    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, archive = -1, None
        for b in batches:
            out, held = [], 0
            for k, p, i in zip(*[b.column(c).to_pylist() for c in ("key", "page_id", "at")], strict=True):
                if i != now:
                    if archive:
                        archive.close()
                    now, archive = i, Archive(stems[i])
                for x in archive.find(k, p):
                    out.append({n: x[n] for n, _ in fields})
                    held += len(x["payload"] or b"") if with_payload else 0
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, pa.schema(fields))
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))
        if archive:
            archive.close()

    routed = keys.select("key", F.col("page_id").cast("long").alias("page_id")).distinct().mapInArrow(route, "key string, page_id long, at long")
    spread = routed.repartition(F.col("at")).sortWithinPartitions("at", "key", "page_id")
    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages as WARC records, then look every one of them up."""
    manifest = write_archives(pages, id_col, url_col, payload_col)
    keys = pick(pages, page_id=id_col, url=url_col)
    return lookup(manifest, keys.select(surt(F.col("url")).alias("key"), "page_id"))
