"""Sources: delimited tables, consent lists, label dictionaries, headers, form workbooks."""

from __future__ import annotations

import csv
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..plans.config import ConfigError, Dataset


def vocabulary(x: str) -> str:
    return re.sub("tribe", "ancestry", re.sub("tribes", "ancestries", x, flags=re.I), flags=re.I)


def first_line(spark: SparkSession, path: str) -> str:
    """The first line by Spark's reader, so any store and compression will do."""
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0] if rows else ""


def header(spark: SparkSession, path: str, sep: str = "\t", quote: str = "") -> list[str]:
    line = first_line(spark, path)
    return next(csv.reader([line], delimiter=sep, quotechar=quote)) if quote else line.split(sep)


def read_strings(spark: SparkSession, path: str, sep: str = "\t", quote: str = "") -> DataFrame:
    """All columns as strings, under _c0, _c1, ...; NA and empty cells are null; no comments."""
    n = len(header(spark, path, sep, quote))
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(n)])
    return spark.read.schema(schema).csv(path, sep=sep, quote=quote or "\x00", escape=quote or "\x00", header=True, nullValue="NA", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=True)


def bind_header(names: Sequence[str | None], cfg: Dataset) -> list[int]:
    """Positions of the columns with a name; names and order must be the configuration's."""
    at = [i for i, x in enumerate(names) if x not in (None, "", "NA")]
    have, want = [vocabulary(names[i] or "") for i in at], [vocabulary(v.name) for v in cfg.variables]
    if len(have) != len(want):
        raise ConfigError(f"dataset {cfg.tag}: {len(have)} columns in the table, {len(want)} in the configuration")
    if wrong := [(a, b) for a, b in zip(have, want, strict=True) if a != b]:
        raise ConfigError(f"dataset {cfg.tag}: column names differ from the configuration: " + ", ".join(f"{a!r} for {b!r}" for a, b in wrong))
    return at


def read_table(spark: SparkSession, path: str, cfg: Dataset, sep: str = "\t", quote: str = "") -> DataFrame:
    """The table as strings under the configuration's tags."""
    at = bind_header(header(spark, path, sep, quote), cfg)
    df = read_strings(spark, path, sep, quote)
    return df.select(*[F.col(f"_c{i}").alias(v.tag) for i, v in zip(at, cfg.variables, strict=True)])


def consent_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one in each line; text after the first white space is not read; an empty file is an empty list."""
    first = F.split(F.trim("value"), "[ \t]+")[0]
    return spark.read.text(path).select(text.squish(text.lowercase(first)).alias("id")).filter("id <> ''").distinct()


def parse_dictionary(lines: Sequence[str]) -> list[tuple[str, str, int]]:
    """(alias, label, order) of lines like ``Label [Other, Another]``; every label is an alias of its own."""
    tidy = lambda x: re.sub(r"[ -]*-[ -]*", "-", re.sub(r"\s+", " ", x.lower()).strip())
    out: list[tuple[str, str, int]] = []
    for line in lines:
        if ":::" in line:
            raise ConfigError(f"':::' in {line!r}")
        m = re.fullmatch(r"([^\[]+?)(?: \[([^\]]+)\])?\s*", line.rstrip("\n"))
        if not m:
            raise ConfigError(f"not a dictionary line: {line!r}")
        for alias in [m[1], *(m[2].split(", ") if m[2] else [])]:
            out.append((tidy(alias), tidy(m[1]), len(out)))
    seen: set[str] = set()
    for alias, _, _ in out:
        if alias in seen:
            raise ConfigError(f"the alias {alias!r} is there twice")
        seen.add(alias)
    return out


def label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(alias, label, ord) of a file, in the order of its lines; a dictionary is read on the driver."""
    lines = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    return spark.createDataFrame(parse_dictionary([x for x in "\n".join(lines).splitlines() if x.strip()]), "alias string, label string, ord int")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _cell_column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_sheet(path: str, sheet: str) -> list[dict[str, str | None]]:
    """Rows of a sheet of an .xlsx file by the names in its first row."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        ids = {s.get("name"): s.get(f"{{{_NS['r']}}}id") for s in book.iter(f"{{{_NS['m']}}}sheet")}
        if sheet not in ids:
            raise ConfigError(f"{path} has no sheet {sheet!r}")
        target = rels[ids[sheet]].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    grid: list[dict[int, str]] = []
    for row in root.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.findall("m:c", _NS)):
            v, kind = c.find("m:v", _NS), c.get("t")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is None or v.text is None:
                continue
            else:
                value = shared[int(v.text)] if kind == "s" else v.text
            cells[_cell_column(c.get("r")) if c.get("r") else k] = value
        grid.append(cells)
    names = grid[0] if grid else {}
    return [{n: r.get(i) for i, n in names.items()} for r in grid[1:]]


def form_sheet(path: str, sheet: str) -> list[dict[str, str | None]]:
    """A sheet of a form: from an .xlsx workbook, or from ``<path>/<sheet>.csv``."""
    if path.endswith(".xlsx"):
        return xlsx_sheet(path, sheet)
    with open(f"{path}/{sheet}.csv", encoding="utf-8", newline="") as f:
        return [{k: v or None for k, v in r.items()} for r in csv.DictReader(f)]


def csv_header(path: str) -> list[str]:
    with open(path, encoding="utf-8", newline="") as f:
        return next(csv.reader(f), [])
