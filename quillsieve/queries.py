"""Queries over the driver's tables, one or more for each operator, with equal SQL.

The tables hold hardly any mess, so each query makes its own from keys, in SQL
text that both engines read the same (``t`` below), and applies an operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import convert, derive, predicates, text
from .functions.convert import Level
from .operators import depend, labels, profile, ranks, rows
from .plans import config, pipeline
from .plans.expression import compile_text

Make = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Query:
    table: str
    mess: str  # select list
    make: Make
    sql: str | None  # over t


QUERIES: dict[str, Query] = {}
SPECIAL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, source: str, mess: str, make: Make, sql: str | None) -> None:
    QUERIES[name] = Query(source, mess, make, sql)


# ---- SQL pieces ----------------------------------------------------------------

SP = r"[\t-\r\x{85}\p{Z}]"
WD = r"\p{L}\p{M}\p{N}\p{Pc}"


def s_squish(x: str) -> str:
    x = f"regexp_replace({x}, '{SP}+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\A | \\z', '', 'g'), '[ -]*-[ -]*', '-', 'g')"


def s_collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[\\\\/]+', '/', 'g'), '[.]+', '.', 'g')"


def s_unicode(x: str) -> str:
    for a, b in text.UNICODE_REPLACEMENTS:
        x = f"replace({x}, chr({ord(a)}), '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def s_numeric(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{convert.NUMBER}') THEN TRY_CAST(regexp_extract({x}, '{convert.NUMBER}', 1) AS DOUBLE) END"


def s_year(x: str) -> str:
    pick = lambda p: f"CASE WHEN regexp_matches({x}, '{p}') THEN CAST(regexp_extract({x}, '{p}', 1) AS DOUBLE) END"
    y = "coalesce(" + ", ".join(pick(p) for p in (rf"\A(?:{convert.MONTHS}),?([0-9]{{4}})\z", r"\A([0-9]{4})\z", r"\A([0-9]{4})-[0-9]{2}-[0-9]{2}\z", r"\A.*[/ -]([0-9]{2}|[0-9]{4})\z")) + ")"
    full = f"(CASE WHEN {y} <= 21 THEN {y} + 2000 WHEN {y} < 100 THEN {y} + 1900 ELSE {y} END)"
    return f"CASE WHEN {full} >= 1800 THEN {full} END"


def s_pressure(x: str, undelimited: bool = False) -> str:
    p = convert.PRESSURE
    main = f"WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', 1) || '/' || regexp_extract({x}, '{p}', 2)"
    short = f"WHEN regexp_matches({x}, '{convert.UNDELIMITED}') THEN CASE WHEN length({x}) = 4 THEN substr({x}, 1, 2) || '/' || substr({x}, 3) ELSE substr({x}, 1, 3) || '/' || substr({x}, 4) END " if undelimited else ""
    return f"CASE {short}{main} END"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A[^{WD}]+|[^{WD}]*[^{WD})}}\\]]\\z', '', 'g')"


# ---- strings -------------------------------------------------------------------

PART = "p_partkey, concat('  ', p_brand, '  -  ', p_type, chr(9), ' ', p_name, ' ') AS x"
add("str_lowercase", "part", PART, lambda d: d.select("p_partkey", text.lowercase(F.col("x")).alias("y")), "SELECT p_partkey, lower(x) AS y FROM t")
add("str_whitespace", "part", PART, lambda d: d.select("p_partkey", text.squish(F.col("x")).alias("y")), f"SELECT p_partkey, {s_squish('x')} AS y FROM t")
add("str_collapse_repeats", "part", "p_partkey, concat(p_name, '..//', chr(92), p_type, '...', p_brand) AS x", lambda d: d.select("p_partkey", text.collapse_repeats(F.col("x")).alias("y")), f"SELECT p_partkey, {s_collapse('x')} AS y FROM t")
DOC = "doc_id, lang, concat(CASE doc_id % 5 WHEN 0 THEN chr(177) WHEN 1 THEN chr(176) WHEN 2 THEN chr(8211) WHEN 3 THEN chr(8230) ELSE chr(8531) END, text) AS x"


def _chr(d: str) -> str:
    """Spark's chr is for bytes; its char literals are written out instead."""
    for n in (8211, 8230, 8531):
        d = d.replace(f"chr({n})", f"'{chr(n)}'")
    return d


add("str_unicode_map", "documents", _chr(DOC), lambda d: d.select("doc_id", F.md5(text.map_unicode(text.lowercase(F.col("x")))).alias("y")), f"SELECT doc_id, md5({s_unicode('lower(x)')}) AS y FROM t")
add("unicode_residue_counts", "documents", _chr(DOC), lambda d: d.filter(text.has_unicode(F.col("x"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "SELECT lang, count(*) AS n FROM t WHERE regexp_matches(x, '[^\\x01-\\x7f]') GROUP BY lang")
EXCEL = "o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN '=#value!' WHEN o_orderkey % 17 = 0 THEN '#div/0!' WHEN o_orderkey % 19 = 0 THEN 'x#error!' ELSE o_orderpriority END AS x"
_ex = "regexp_matches(x, '" + text.EXCEL_FAILURES + "')"
add("excel_error_nulling", "orders", EXCEL, lambda d: d.select("o_orderkey", text.null_excel_failures(F.col("x")).alias("y")), f"SELECT o_orderkey, CASE WHEN NOT {_ex} THEN x END AS y FROM t")
add("excel_error_counts", "orders", EXCEL, lambda d: d.groupBy("o_orderstatus").agg(F.count_if(text.is_excel_failure(F.col("x"))).alias("n")), f"SELECT o_orderstatus, count(*) FILTER (WHERE {_ex}) AS n FROM t GROUP BY o_orderstatus")
BAL = "c_custkey, CASE c_custkey % 6 WHEN 0 THEN concat('.', CAST(c_custkey AS STRING), ' kg') WHEN 1 THEN concat(' > ', CAST(c_custkey AS STRING)) WHEN 2 THEN concat('<', c_mktsegment) WHEN 3 THEN concat(' - ', CAST(c_custkey AS STRING), ' below') WHEN 4 THEN concat('[;', c_mktsegment, ');+') ELSE concat('é', c_name, ']!') END AS x"
add("str_leading_decimal", "customer", BAL, lambda d: d.select("c_custkey", text.leading_decimal(F.col("x")).alias("y")), "SELECT c_custkey, regexp_replace(x, '\\A\\.([0-9]+)[ %a-zA-Z-]*\\z', '0.\\1') AS y FROM t")
_gt = f"regexp_replace(regexp_replace(x, '\\A *> *([{WD}]+)', 'greater than \\1'), '\\A *< *([{WD}]+)', 'less than \\1')"
add("str_gt_lt_words", "customer", BAL, lambda d: d.select("c_custkey", text.compare_words(F.col("x")).alias("y")), f"SELECT c_custkey, {_gt} AS y FROM t")
add("str_negative_to_null", "customer", BAL, lambda d: d.select("c_custkey", text.normalize_missing(text.negatives_to_na(F.col("x"))).alias("y")), "SELECT c_custkey, CASE WHEN NOT regexp_matches(x, '\\A *- *[0-9]+.*\\z') THEN x END AS y FROM t")
add("str_strip_nonword", "customer", BAL, lambda d: d.select("c_custkey", text.strip_edges(F.col("x")).alias("y")), f"SELECT c_custkey, {s_strip('x')} AS y FROM t")
NAS = "c_custkey, CASE c_custkey % 14 WHEN 0 THEN 'n/a' WHEN 1 THEN 'na' WHEN 2 THEN 'not applicable;' WHEN 3 THEN 'nil' WHEN 4 THEN '' WHEN 5 THEN 'not sure' WHEN 6 THEN 'nan' WHEN 7 THEN 'not assessed' WHEN 8 THEN 'unavailable' WHEN 9 THEN 'unknown' WHEN 10 THEN 'not available' WHEN 11 THEN 'not done' WHEN 12 THEN 'none' ELSE c_name END AS x"
add("normalize_missing", "customer", NAS, lambda d: d.select("c_custkey", text.normalize_missing(F.col("x")).alias("y")), f"SELECT c_custkey, CASE WHEN NOT regexp_matches(x, '{text.MISSING}') THEN x END AS y FROM t")
add("na_values", "orders", "o_orderkey, lower(o_orderpriority) AS x", lambda d: d.select("o_orderkey", text.null_values(F.col("x"), ["4-not specified"]).alias("y")), "SELECT o_orderkey, nullif(x, '4-not specified') AS y FROM t")
add("suppress_output", "orders", "o_orderkey, o_orderpriority AS x", lambda d: d.select("o_orderkey", text.null_values(F.col("x"), suppress=True).alias("y")), "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS y FROM t")
add("str_vocabulary", "part", "p_partkey, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' Tribe' WHEN 1 THEN ' tribes' ELSE ' scribe' END) AS x", lambda d: d.select("p_partkey", text.vocabulary(F.col("x")).alias("y")), "SELECT p_partkey, regexp_replace(regexp_replace(x, 'tribes', 'ancestries', 'gi'), 'tribe', 'ancestry', 'gi') AS y FROM t")

# ---- types ---------------------------------------------------------------------

SIZE = "p_partkey, p_type, CASE p_partkey % 7 WHEN 0 THEN concat(CAST(p_size AS STRING), ' kg') WHEN 1 THEN concat(CAST(p_size AS STRING), '.5cm') WHEN 2 THEN concat(CAST(p_size AS STRING), ' / 100') WHEN 3 THEN concat('-', CAST(p_size AS STRING)) WHEN 4 THEN p_name WHEN 5 THEN concat(CAST(p_size AS STRING), '.2and200') ELSE concat(CAST(p_size AS STRING), '.') END AS x"
add("parse_numeric", "part", SIZE, lambda d: d.select("p_partkey", convert.parse_numeric(F.col("x")).alias("y")), f"SELECT p_partkey, {s_numeric('x')} AS y FROM t")
add("invalid_numeric_counts", "part", SIZE, lambda d: profile.rejected_entries(d, F.col("x"), convert.parse_numeric(F.col("x"))), f"SELECT x AS value, count(*) AS n FROM t WHERE ({s_numeric('x')}) IS NULL GROUP BY x")
BP = "p_partkey, concat(CAST(p_size + 100 AS STRING), CASE p_partkey % 6 WHEN 0 THEN '/' WHEN 1 THEN ' - ' WHEN 2 THEN ', ' WHEN 3 THEN '' WHEN 4 THEN ' over ' ELSE '  /  ' END, CAST(p_partkey % 60 + 50 AS STRING), CASE WHEN p_partkey % 11 = 0 THEN ' mmhg' ELSE '' END) AS x"
add("bp_is_valid", "part", BP, lambda d: d.select("p_partkey", convert.is_pressure(F.col("x")).alias("strict"), convert.is_pressure(F.col("x"), True).alias("loose"), convert.is_pressure(F.col("x"), True, True).alias("digits")), f"SELECT p_partkey, regexp_matches(x, '{convert.PRESSURE}\\z') AS strict, regexp_matches(x, '{convert.PRESSURE}') AS loose, regexp_matches(x, '{convert.PRESSURE}') OR regexp_matches(x, '{convert.UNDELIMITED}') AS digits FROM t")
add("bp_normalize", "part", BP, lambda d: d.select("p_partkey", convert.parse_pressure(F.col("x")).alias("y")), f"SELECT p_partkey, {s_pressure('x')} AS y FROM t")
add("bp_undelimited", "part", BP, lambda d: d.select("p_partkey", convert.parse_pressure(F.col("x"), True).alias("y")), f"SELECT p_partkey, {s_pressure('x', True)} AS y FROM t")
add("invalid_bp_counts", "part", BP, lambda d: profile.rejected_entries(d, F.col("x"), convert.parse_pressure(F.col("x"))), f"SELECT x AS value, count(*) AS n FROM t WHERE ({s_pressure('x')}) IS NULL GROUP BY x")
STATUS = (Level("open", ("o", "op.*n")), Level("filled", ("f",)))
FACTOR = "o_orderkey, o_orderpriority, CASE o_orderkey % 5 WHEN 0 THEN 'opeen' WHEN 1 THEN 'filled' WHEN 2 THEN 'strange' ELSE lower(o_orderstatus) END AS x"
_lv = "CASE WHEN regexp_matches(x, '^o$|^op.*n$') THEN 'open' WHEN regexp_matches(x, '^f$') THEN 'filled' ELSE x END"
_fac = f"CASE WHEN {_lv} IN ('open', 'filled') THEN {_lv} END"
add("factor_levels", "orders", FACTOR, lambda d: d.select("o_orderkey", convert.parse_levels(F.col("x"), STATUS).alias("y")), f"SELECT o_orderkey, {_fac} AS y FROM t")
add("factor_alternates", "orders", FACTOR, lambda d: d.select("o_orderkey", convert.map_levels(F.col("x"), STATUS).alias("y")), f"SELECT o_orderkey, {_lv} AS y FROM t")
add("invalid_factor_counts", "orders", FACTOR, lambda d: profile.rejected_entries(d, F.col("x"), convert.parse_levels(F.col("x"), STATUS)), f"SELECT x AS value, count(*) AS n FROM t WHERE ({_fac}) IS NULL GROUP BY x")
ORDINAL = tuple(Level(x) for x in ("5-low", "4-not specified", "3-medium", "2-high"))
add("ordinal_rank", "orders", "o_orderkey, lower(o_orderpriority) AS x", lambda d: d.select("o_orderkey", convert.level_rank(convert.parse_levels(F.col("x"), ORDINAL), ORDINAL).cast("bigint").alias("y")), "SELECT o_orderkey, CAST(CASE x WHEN '5-low' THEN 1 WHEN '4-not specified' THEN 2 WHEN '3-medium' THEN 3 WHEN '2-high' THEN 4 END AS BIGINT) AS y FROM t")
add("factor_counts_with_zero", "orders", "nullif(lower(o_orderstatus), 'p') AS x", lambda d: profile.level_counts(d, "x", ["o", "f", "never"]), "SELECT coalesce(l.v, t.x) AS value, count(t.x) + CASE WHEN coalesce(l.v, t.x) IS NULL THEN count(*) ELSE 0 END AS n FROM t FULL JOIN (VALUES ('o'), ('f'), ('never')) l(v) ON l.v = t.x GROUP BY 1")
NUMBERED = (Level("10", ("1.*",)), Level("20", ("2.*",)), Level("30", ("3.*",)))
add("categorical_to_numeric", "orders", "o_orderkey, lower(o_orderpriority) AS x", lambda d: d.select("o_orderkey", convert.levels_to_numeric(F.col("x"), NUMBERED).alias("y")), "SELECT o_orderkey, CAST(CASE substr(x, 1, 1) WHEN '1' THEN 10 WHEN '2' THEN 20 WHEN '3' THEN 30 END AS DOUBLE) AS y FROM t")
DAY = "lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0')"
DATE = f"o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN concat(CAST(year(o_orderdate) AS STRING), '-05-', {DAY}) WHEN 1 THEN concat('5/', {DAY}, '/', substr(CAST(year(o_orderdate) AS STRING), 3, 2)) WHEN 2 THEN CAST(year(o_orderdate) AS STRING) WHEN 3 THEN concat('march,', CAST(year(o_orderdate) AS STRING)) WHEN 4 THEN concat('april ', CAST(year(o_orderdate) AS STRING)) WHEN 5 THEN concat('12-12-', CAST(o_orderkey % 30 + 1790 AS STRING)) ELSE o_orderpriority END AS x"
add("parse_date_year", "orders", DATE, lambda d: d.select("o_orderkey", convert.parse_year(F.col("x")).alias("y")), f"SELECT o_orderkey, {s_year('x')} AS y FROM t")
add("invalid_date_counts", "orders", DATE, lambda d: profile.rejected_entries(d, F.col("x"), convert.parse_year(F.col("x"))), f"SELECT x AS value, count(*) AS n FROM t WHERE ({s_year('x')}) IS NULL GROUP BY x")
MIXED = "l_orderkey, l_linenumber, concat(CAST(CAST(l_quantity AS INT) AS STRING), CASE WHEN l_orderkey % 9 = 0 THEN '/' ELSE ' units' END, '9') AS a, concat(CAST(year(l_shipdate) AS STRING), CASE WHEN l_orderkey % 8 = 0 THEN 'x' ELSE '-01-02' END) AS b, lower(l_returnflag) AS c"
RETURNED = (Level("accepted", ("a",)), Level("returned", ("r",)))
add("type_conversion_mixed", "lineitem", MIXED, lambda d: d.select("l_orderkey", "l_linenumber", convert.parse_numeric(F.col("a")).alias("a"), convert.parse_year(F.col("b")).alias("b"), convert.parse_levels(F.col("c"), RETURNED).alias("c")), f"SELECT l_orderkey, l_linenumber, {s_numeric('a')} AS a, {s_year('b')} AS b, CASE c WHEN 'a' THEN 'accepted' WHEN 'r' THEN 'returned' END AS c FROM t")

# ---- filters and bounds ----------------------------------------------------------

CUST = "nullif(c_custkey % 500, 0) AS id, c_custkey, c_acctbal"


def _consent(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "customer").selectExpr(*_split(CUST))
        o = table(spark, sf_dir, "orders")
        inc, exc = o.filter("o_orderstatus = 'O'").selectExpr("o_custkey % 500 AS id"), o.filter("o_orderstatus = 'F' AND o_orderkey % 7 = 0").selectExpr("o_custkey % 500 AS id")
        if kind == "exclude":
            return rows.consent(d, "id", exclude=exc).select("c_custkey")
        if kind == "include":
            return rows.consent(d, "id", include=inc).select("c_custkey")
        if kind == "both":
            return rows.consent(d, "id", inc, exc).select("c_custkey")
        if kind == "counts":
            return rows.consent_counts(d, "id", inc, exc)
        return rows.consent_ambiguous(d, "id", inc, exc)

    return run


def _split(select: str) -> list[str]:
    """A select list at its top-level commas."""
    out, depth, now, quoted = [], 0, "", False
    for ch in select:
        quoted ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quoted else 0
        if ch == "," and not depth and not quoted:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


_inc, _exc = "(SELECT o_custkey % 500 FROM orders WHERE o_orderstatus = 'O')", "(SELECT o_custkey % 500 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0)"
_t = f"WITH t AS (SELECT {CUST} FROM customer) "
_not_exc, _is_inc = f"(id IS NULL OR id NOT IN {_exc})", f"(id IS NOT NULL AND id IN {_inc})"
SPECIAL["consent_exclude"] = (_consent("exclude"), _t + f"SELECT c_custkey FROM t WHERE {_not_exc}")
SPECIAL["consent_include"] = (_consent("include"), _t + f"SELECT c_custkey FROM t WHERE {_is_inc}")
SPECIAL["consent_both"] = (_consent("both"), _t + f"SELECT c_custkey FROM t WHERE {_not_exc} AND {_is_inc}")
SPECIAL["consent_ambiguous"] = (_consent("ambiguous"), _t + f"SELECT DISTINCT id FROM t WHERE id IS NOT NULL AND {_not_exc} AND id NOT IN {_inc}")
SPECIAL["consent_counts"] = (_consent("counts"), _t + f"SELECT count(*) AS n_initial, count(*) FILTER (WHERE NOT {_not_exc}) AS n_no, count(*) FILTER (WHERE {_not_exc} AND {_is_inc}) AS n_yes FROM t")
AGE = "c_custkey, nullif(c_acctbal / 100, 0) AS age, nullif(c_custkey % 10, 0) AS id"
add("age_filter", "customer", AGE, lambda d: rows.by_age(d, "age", 18).select("c_custkey", "age"), "SELECT c_custkey, age FROM t WHERE age >= 18")
add("age_excluded_count", "customer", AGE, lambda d: d.agg((F.count(F.lit(1)) - F.count_if(F.col("age") >= 18)).alias("n")), "SELECT count(*) - count(*) FILTER (WHERE age >= 18) AS n FROM t")
add("missing_id_filter", "customer", AGE, lambda d: rows.by_missing_id(d, "id").select("c_custkey", "id"), "SELECT c_custkey, id FROM t WHERE id IS NOT NULL")
LINE = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
LIMITS = {"l_extendedprice": {"min": 5000, "max": 60000}, "l_quantity": {"max": 40}}
add("bounds_min_max", "lineitem", LINE, lambda d: rows.bounds(d, LIMITS).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice BETWEEN 5000 AND 60000 THEN l_extendedprice END AS l_extendedprice, CASE WHEN l_quantity <= 40 THEN l_quantity END AS l_quantity FROM t")
_clip = "SELECT *, CASE WHEN l_extendedprice BETWEEN 5000 AND 60000 THEN l_extendedprice END AS p FROM t"
_sd = "(SELECT avg(p) AS m, stddev_samp(p) AS s FROM c)"
add("bounds_min_max_sd", "lineitem", LINE, lambda d: rows.bounds(d, {"l_extendedprice": LIMITS["l_extendedprice"] | {"sd": 1.5}}).select("l_orderkey", "l_linenumber", "l_extendedprice"), f"SELECT l_orderkey, l_linenumber, CASE WHEN p BETWEEN m - 1.5 * s AND m + 1.5 * s THEN p END AS l_extendedprice FROM ({_clip}) c0, (SELECT avg(p) AS m, stddev_samp(p) AS s FROM ({_clip}))")
add("bounds_sd", "events", "event_id, value", lambda d: rows.bounds(d, {"value": {"sd": 1}}), "SELECT event_id, CASE WHEN value BETWEEN m - s AND m + s THEN value END AS value FROM t, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM t)")
add("bounds_counts", "lineitem", LINE, lambda d: rows.bounds_counts(d, {"l_extendedprice": LIMITS["l_extendedprice"] | {"sd": 1.5}, "l_quantity": LIMITS["l_quantity"]}), f"SELECT 'l_extendedprice' AS variable, count(*) FILTER (WHERE l_extendedprice < 5000) AS n_below, count(*) FILTER (WHERE l_extendedprice > 60000) AS n_above, count(*) FILTER (WHERE p NOT BETWEEN m - 1.5 * s AND m + 1.5 * s) AS n_beyond_sd FROM ({_clip}), (SELECT avg(p) AS m, stddev_samp(p) AS s FROM ({_clip})) UNION ALL SELECT 'l_quantity', 0, count(*) FILTER (WHERE l_quantity > 40), 0 FROM t")


def _metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.by_metric(table(spark, sf_dir, "customer"), "c_custkey", n, 10).select("c_custkey", "c_name")


SPECIAL["metric_exclusion"] = (_metric, "SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) <= 10")

# ---- predicates --------------------------------------------------------------------

DEP = "l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS a, CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS b, nullif(l_discount, 0.03) AS x, nullif(l_tax, 0.05) AS y, nullif(l_quantity, 7) AS w"
KEYS = ("l_orderkey", "l_linenumber")


def _dep(c: Callable[[], Column]) -> Make:
    return lambda d: d.select(*KEYS, c().alias("ok"))


def _ok(test: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, {test} AS ok FROM t"


def _later(name: str) -> Callable[[], Column]:
    """A column that is made when a session exists."""
    return lambda: F.col(name)


A, B, X, Y, Wt = map(_later, "abxyw")
add("dep_on_yes", "lineitem", DEP, _dep(lambda: predicates.depends_on_yes(A(), B(), ["yes"], ["maybe"], ["R"])), _ok("a IS NULL OR a = 'R' OR coalesce(b = 'yes', false)"))
add("dep_on_not_na", "lineitem", DEP, _dep(lambda: predicates.depends_on_not_na(A(), B(), ["no"])), _ok("a IS NULL OR (b IS NOT NULL AND b <> 'no')"))
add("dep_less_than", "lineitem", DEP, _dep(lambda: predicates.less_than(X(), Y())), _ok("x IS NULL OR y IS NULL OR x < y"))
add("dep_greater_than", "lineitem", DEP, lambda d: d.select(*KEYS, predicates.greater_than(X(), Y()).alias("ok"), predicates.greater_than(X(), Y(), False).alias("strictly")), "SELECT l_orderkey, l_linenumber, x IS NULL OR y IS NULL OR x >= y AS ok, x IS NULL OR y IS NULL OR x > y AS strictly FROM t")
add("dep_duplicate", "lineitem", DEP, _dep(lambda: predicates.duplicate_of(X(), Y())), _ok("x IS NULL OR y IS NULL OR x = y"))
add("dep_bmi", "lineitem", DEP, _dep(lambda: predicates.computed_bmi(X() * 100, Wt(), Y() * 20, 40)), _ok("x IS NULL OR w IS NULL OR y IS NULL OR CASE WHEN y = 0 THEN false ELSE abs(w / ((y * 20) * (y * 20)) - x * 100) <= 40 END"))
add("dep_year_age", "lineitem", DEP, _dep(lambda: predicates.year_fits_age(Wt() + 1960, Wt() + X() * 100, 2020, 32)), _ok("w IS NULL OR x IS NULL OR (2020 - (w + 1960) - 32 < w + x * 100 AND w + x * 100 < 2020 - (w + 1960) + 32)"))


def _rules() -> list[depend.Rule]:
    return [
        depend.Rule("x", "d1", predicates.less_than(F.col("x"), F.col("y")), exclude=("x", "y")),
        depend.Rule("x", "d2", F.col("w") < 45, exclude=("w",)),
        depend.Rule("a", "d1", predicates.depends_on_yes(F.col("a"), F.col("b")), exclude=("a",)),
    ]


_r1, _r2, _r3 = "(x IS NULL OR y IS NULL OR x < y)", "(w < 45)", "(a IS NULL OR coalesce(b = 'yes', false))"
_fail = " UNION ALL ".join(f"SELECT l_orderkey AS subject_id, '{v}' AS variable, '{k}' AS dependency FROM t WHERE NOT {r}" for v, k, r in (("x", "d1", _r1), ("x", "d2", _r2), ("a", "d1", _r3)))
_flag = f"(SELECT *, bool_or(coalesce(NOT {_r1}, false)) OVER o AS f1, bool_or(coalesce(NOT {_r2}, false)) OVER o AS f2, bool_or(coalesce(NOT {_r3}, false)) OVER o AS f3 FROM t WINDOW o AS (PARTITION BY l_orderkey))"
add("dependency_failures", "lineitem", DEP, lambda d: depend.failures(d, "l_orderkey", _rules()), _fail)
add("dependency_scalar_all", "lineitem", DEP, lambda d: depend.scalar_result(d, F.bool_and(F.col("w") < 51)), "SELECT bool_and(w < 51) AS holds FROM t")
add("dependency_exclude", "lineitem", DEP, lambda d: depend.null_failures(d, "l_orderkey", _rules()), f"SELECT l_orderkey, l_linenumber, CASE WHEN NOT f3 THEN a END AS a, b, CASE WHEN NOT f1 THEN x END AS x, CASE WHEN NOT f1 THEN y END AS y, CASE WHEN NOT f2 THEN w END AS w FROM {_flag}")
_one = [lambda: depend.Rule("w", "d2", F.col("w") < 45, exclude_all=True)]
add("dependency_exclude_all", "lineitem", DEP, lambda d: depend.null_failures(d.drop("l_linenumber"), "l_orderkey", [_one[0]()]), f"SELECT l_orderkey, CASE WHEN NOT f2 THEN a END AS a, CASE WHEN NOT f2 THEN b END AS b, CASE WHEN NOT f2 THEN x END AS x, CASE WHEN NOT f2 THEN y END AS y, CASE WHEN NOT f2 THEN w END AS w FROM {_flag}")
add("dependency_na_counts", "lineitem", DEP, lambda d: depend.null_counts(d, "l_orderkey", _rules()), f"SELECT count(x) FILTER (WHERE f1) + count(y) FILTER (WHERE f1) + count(w) FILTER (WHERE f2) + count(a) FILTER (WHERE f3) AS n_new_null, count(*) * 4 AS n_possible FROM {_flag}")
add("dependency_report", "lineitem", DEP, lambda d: depend.rule_report(d, "l_orderkey", _rules(), 5), f"WITH f AS ({_fail}), u AS (SELECT DISTINCT * FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY variable, dependency ORDER BY subject_id) AS k FROM u) SELECT n.variable, n.dependency, n.n_failures, l.ids FROM (SELECT variable, dependency, count(*) AS n_failures FROM f GROUP BY 1, 2) n JOIN (SELECT variable, dependency, string_agg(CAST(subject_id AS VARCHAR), ',' ORDER BY subject_id) AS ids FROM r WHERE k <= 5 GROUP BY 1, 2) l USING (variable, dependency)")
add("dependency_failed_ids", "lineitem", DEP, lambda d: depend.failed_ids(d, "l_orderkey", _rules()), f"SELECT variable, dependency, subject_id, count(*) AS n_rows FROM ({_fail}) GROUP BY 1, 2, 3")
add("dep_failures_by_subject", "lineitem", DEP, lambda d: depend.failures_by_subject(depend.failures(d, "l_orderkey", _rules())), f"SELECT subject_id, count(DISTINCT variable) AS n FROM ({_fail}) GROUP BY 1")

# ---- derived columns -----------------------------------------------------------------


def _expr(code: str, out: str = "y", keys: tuple[str, ...] = KEYS) -> Make:
    def make(d: DataFrame) -> DataFrame:
        made = compile_text(code, {c: F.col(c) for c in d.columns})
        for n, c in made.steps:
            d = d.withColumn(n, c)
        return d.select(*keys, made.value.alias(out))

    return make


add("derived_simple", "lineitem", LINE, _expr("l_extendedprice * (1 - l_discount)"), "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS y FROM t")
_chain = "tag: C\nglobals: {min_age_for_inclusion: null}\nvariables: {l_orderkey: {name: l_orderkey, canonical_name: k, type: string, subject_id: true}}\nderived: {d2: {name: d2, code: 'd1 + l_tax'}, d1: {name: d1, code: 'l_discount * 2'}, d3: {name: d3, code: 'd2 - d1'}}"


def _chained(d: DataFrame) -> DataFrame:
    import yaml

    cfg = config.build(config.resolve(yaml.safe_load(_chain), {"models": {}}))
    return pipeline.derive(d, cfg).select(*KEYS, "d1", "d2", "d3")


add("derived_chain", "lineitem", LINE, _chained, "SELECT l_orderkey, l_linenumber, l_discount * 2 AS d1, l_discount * 2 + l_tax AS d2, (l_discount * 2 + l_tax) - l_discount * 2 AS d3 FROM t")
add("derived_multistatement", "lineitem", LINE, _expr("net <- l_extendedprice * (1 - l_discount)\nnet[net > 50000] <- 50000\nnet * (1 + l_tax)"), "SELECT l_orderkey, l_linenumber, (CASE WHEN l_extendedprice * (1 - l_discount) > 50000 THEN 50000 ELSE l_extendedprice * (1 - l_discount) END) * (1 + l_tax) AS y FROM t")
_sbp = s_pressure("x")
add("derived_sbp_dbp", "part", BP, lambda d: d.select("p_partkey", convert.parse_pressure(F.col("x")).alias("bp")).transform(lambda e: e.select("p_partkey", compile_text("as.numeric(stringr::str_replace(bp, '^(\\\\d+)/(\\\\d+)$', '\\\\1'))", {"bp": F.col("bp")}).value.alias("sbp"), compile_text("as.numeric(str_replace(bp, '^(\\\\d+)/(\\\\d+)$', '\\\\2'))", {"bp": F.col("bp")}).value.alias("dbp"))), f"SELECT p_partkey, TRY_CAST(split_part({_sbp}, '/', 1) AS DOUBLE) AS sbp, TRY_CAST(split_part({_sbp}, '/', 2) AS DOUBLE) AS dbp FROM t")
add("derived_unit_fix", "lineitem", LINE, _expr("h <- l_quantity\nh[h < 10 & !is.na(h)] <- h[h < 10 & !is.na(h)] * 100\nh"), "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN l_quantity * 100 ELSE l_quantity END AS y FROM t")
add("derived_ifelse_detect", "documents", "doc_id, text", _expr("ifelse(stringr::str_detect(text, 'the'), 'has', 'none')", keys=("doc_id",)), "SELECT doc_id, CASE WHEN regexp_matches(text, 'the') THEN 'has' ELSE 'none' END AS y FROM t")
FAMILY = "c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'uncle, mother' WHEN 1 THEN 'aunt;grandfather' WHEN 2 THEN NULL WHEN 3 THEN 'cousin: sibling''s' WHEN 4 THEN ' children ' ELSE c_mktsegment END AS x"
_rel = derive.RELATIVES.replace("'", "''")
add("first_degree", "customer", FAMILY.replace("''", "''"), lambda d: d.select("c_custkey", derive.first_degree(F.col("x")).alias("y")), f"SELECT c_custkey, CASE WHEN x IS NULL THEN NULL WHEN len(list_filter(regexp_split_to_array(x, '[:,;]'), lambda e: regexp_matches(regexp_replace(e, '{SP}', '', 'g'), '{_rel}'))) > 0 THEN 'yes' ELSE 'no' END AS y FROM t")
RANK = "c_custkey, c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS x, nullif(c_mktsegment, 'MACHINERY') AS seg"


def _q(p: str) -> str:
    return derive.normal_quantile_sql(p, "")


def _ranked(x: str, part: str, src: str) -> str:
    return f"SELECT *, CASE WHEN {x} IS NOT NULL AND {part} IS NOT NULL THEN (row_number() OVER (PARTITION BY {part}, {x} IS NOT NULL ORDER BY {x}, c_custkey) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY {part}, {x} IS NOT NULL) END AS p FROM {src}"


add("rank_normal", "customer", RANK, lambda d: ranks.rank_normal(d, "x", "z", tie=F.col("c_custkey")).select("c_custkey", F.round("z", 6).alias("z")), f"SELECT c_custkey, round({_q('p')}, 6) AS z FROM ({_ranked('x', '1', 't')})")
add("rank_normal_stratified", "customer", RANK, lambda d: ranks.rank_normal(d, "x", "z", ["seg"], tie=F.col("c_custkey")).select("c_custkey", F.round("z", 6).alias("z")), f"SELECT c_custkey, round({_q('p')}, 6) AS z FROM ({_ranked('z1', '1', f'(SELECT * EXCLUDE (p), {_q(chr(112))} AS z1 FROM ({_ranked(chr(120), chr(115) + chr(101) + chr(103), chr(116))}))')})")

# ---- labels -----------------------------------------------------------------------------

NAME = "p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(substr(p_name, 1, 1), substr(p_name, 3, 1), substr(p_name, 2, 1), substr(p_name, 4)) WHEN 1 THEN concat(p_name, 'xyz') WHEN 2 THEN p_brand ELSE p_name END AS x"


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("alias")).distinct()
    return names.select("alias", F.split("alias", " ")[0].alias("label"), F.row_number().over(W.orderBy("alias")).alias("ord"))


_dict = "d AS (SELECT alias, split_part(alias, ' ', 1) AS label, row_number() OVER (ORDER BY alias) AS ord FROM (SELECT DISTINCT p_name AS alias FROM part))"
_lab = f"WITH t AS (SELECT {NAME} FROM part), {_dict}, v AS (SELECT DISTINCT x AS value FROM t), m AS (SELECT * FROM v WHERE value NOT IN (SELECT alias FROM d)), s AS (SELECT value, alias, label, ord, 1 - damerau_levenshtein(value, alias) / greatest(length(value), length(alias))::DOUBLE AS sim FROM m, d), r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY sim DESC, ord) AS k FROM s), two AS (SELECT value, max(CASE WHEN k = 1 THEN alias END) AS top, max(CASE WHEN k = 1 THEN sim END) AS top_sim, max(CASE WHEN k = 1 THEN label END) AS top_label, max(CASE WHEN k = 2 THEN alias END) AS second, max(CASE WHEN k = 2 THEN sim END) AS second_sim, max(CASE WHEN k = 2 THEN label END) AS second_label FROM r WHERE k <= 2 GROUP BY value), dec AS (SELECT *, CASE WHEN top_sim < 0.8 THEN NULL WHEN second_sim >= 0.75 * top_sim AND top_label <> second_label THEN NULL ELSE top_label END AS label, CASE WHEN top_sim < 0.8 THEN '{labels.TOO_LOW}' WHEN second_sim >= 0.75 * top_sim AND top_label = second_label THEN '{labels.CONCORDANT}' WHEN second_sim >= 0.75 * top_sim THEN '{labels.DISCORDANT}' ELSE 'success' END AS reasoning FROM two) "


def _labels(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "part").selectExpr(*_split(NAME)), _dictionary(spark, sf_dir))


SPECIAL["label_exact_match"] = (_labels(lambda d, k: d.join(F.broadcast(k), d["x"] == k["alias"]).select("p_partkey", "label")), _lab + "SELECT p_partkey, label FROM t JOIN d ON x = alias")


def _top2(d: DataFrame, k: DataFrame) -> DataFrame:
    missed = d.select(F.col("x").alias("value")).distinct().join(F.broadcast(k), F.col("value") == F.col("alias"), "left_anti")
    return labels.top_two(missed, k).select("value", "top", F.round("top_sim", 6).alias("top_sim"), "second", F.round("second_sim", 6).alias("second_sim"))


SPECIAL["fuzzy_match_top2"] = (_labels(_top2), _lab + "SELECT value, top, round(top_sim, 6) AS top_sim, second, round(second_sim, 6) AS second_sim FROM two")
SPECIAL["fuzzy_match_decision"] = (_labels(lambda d, k: labels.decisions(d, "x", k).filter("reasoning <> 'exact'").select("value", "label", "reasoning")), _lab + "SELECT value, label, reasoning FROM dec")
SPECIAL["fuzzy_match_report"] = (_labels(lambda d, k: labels.report(d, "x", k)), _lab + "SELECT value, n, label, reasoning, top, round(top_sim, 2) AS top_sim, second, round(second_sim, 2) AS second_sim FROM dec JOIN (SELECT x AS value, count(*) AS n FROM t GROUP BY x) USING (value)")
SPECIAL["label_harmonize"] = (_labels(lambda d, k: labels.harmonize(d, "x", k)), _lab + "SELECT p_partkey, coalesce(d.label, dec.label) AS x FROM t LEFT JOIN d ON t.x = d.alias LEFT JOIN dec ON t.x = dec.value")
SPECIAL["label_harmonize_counts"] = (_labels(lambda d, k: labels.harmonize_counts(d, "x", k)), _lab + "SELECT count(d.alias) AS n_perfect, count(*) FILTER (WHERE d.alias IS NULL AND dec.label IS NOT NULL) AS n_imperfect, count(*) FILTER (WHERE d.alias IS NULL AND dec.label IS NULL) AS n_failed FROM t LEFT JOIN d ON t.x = d.alias LEFT JOIN dec ON t.x = dec.value")
# ---- profiles ------------------------------------------------------------------------------

SOME = "l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 3 THEN NULL ELSE l_extendedprice END AS price, l_quantity, l_returnflag, nullif(l_linestatus, 'O') AS status"


def _summary(d: DataFrame) -> DataFrame:
    out = profile.numeric_summary(d, ["price", "l_quantity"])
    return out.select("variable", *[F.round(c, 4).alias(c) for c in profile.SUMMARY[:-1]], "n_null")


_sum = " UNION ALL ".join("SELECT '" + c + "' AS variable, round(avg(" + c + "), 4) AS mean, " + ", ".join(f"round(quantile_cont({c}, {k / 10}::DOUBLE), 4) AS {n}" for k, n in enumerate(profile.SUMMARY[1:12])) + f", count(*) - count({c}) AS n_null FROM t" for c in ("price", "l_quantity"))
add("numeric_summary", "lineitem", SOME, _summary, _sum)
add("value_counts", "lineitem", SOME, lambda d: profile.value_counts(d, ["l_returnflag", "status"]), "SELECT 'l_returnflag' AS variable, l_returnflag AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM t GROUP BY 2")
add("contingency_table", "lineitem", SOME, lambda d: profile.contingency(d, "l_returnflag", "status"), "SELECT l_returnflag AS a, status AS b, count(*) AS n FROM t GROUP BY 1, 2")
add("histogram_bins", "lineitem", SOME, lambda d: profile.bin_count(d, "price"), "SELECT least(50, count(DISTINCT price) + max(CASE WHEN price IS NULL THEN 1 ELSE 0 END)) AS bins FROM t")
_ends = "(SELECT min(price) AS lo, count(price) AS c, (max(price) - min(price) + 1) / least(50, count(DISTINCT price) + max(CASE WHEN price IS NULL THEN 1 ELSE 0 END)) AS w FROM t)"
add("histogram", "lineitem", SOME, lambda d: profile.histogram(d, "price").select("bin", F.round("start", 6).alias("start"), "n", F.round("share", 9).alias("share")), f"SELECT CAST(floor((price - lo) / w) AS BIGINT) AS bin, round(min(lo) + CAST(floor((price - lo) / w) AS BIGINT) * min(w), 6) AS start, count(*) AS n, round(count(*) / min(c)::DOUBLE, 9) AS share FROM t, {_ends} WHERE price IS NOT NULL GROUP BY 1")
add(
    "histogram_few_values", "lineitem", "CASE WHEN l_linenumber < 7 THEN l_linenumber END AS x",
    lambda d: profile.histogram(d, "x").select("bin", F.round("start", 6).alias("start"), "n"),
    "SELECT CAST(floor((x - lo) / w) AS BIGINT) AS bin, round(min(lo + floor((x - lo) / w) * w), 6) AS start, count(*) AS n FROM t, (SELECT min(x)::DOUBLE AS lo, (max(x) - min(x) + 1)::DOUBLE / least(50, count(DISTINCT x)) AS w FROM t) WHERE x IS NOT NULL GROUP BY 1",
)
add("histogram_by_group", "lineitem", SOME, lambda d: profile.histogram(d, "price", "l_returnflag").select("group", "bin", "n"), f"SELECT l_returnflag AS \"group\", CAST(floor((price - lo) / w) AS BIGINT) AS bin, count(*) AS n FROM t, {_ends} WHERE price IS NOT NULL GROUP BY 1, 2")
add("multimodal_means", "lineitem", SOME, lambda d: profile.group_means(d, "price", "l_returnflag").select("group", F.round("mean", 4).alias("mean"), "n"), "SELECT l_returnflag AS \"group\", round(avg(price), 4) AS mean, count(price) AS n FROM t GROUP BY 1")
add("sd_guides", "lineitem", SOME, lambda d: profile.sd_guides(d, "price").select(F.round("low", 3).alias("low"), F.round("high", 3).alias("high")), "SELECT round(avg(price) - 3 * stddev_samp(price), 3) AS low, round(avg(price) + 3 * stddev_samp(price), 3) AS high FROM t")
add("top_ten", "orders", "o_orderkey, o_totalprice", lambda d: profile.top(d, "o_totalprice", "o_orderkey"), "SELECT o_orderkey, o_totalprice FROM t ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("na_count_by_subject", "lineitem", SOME, lambda d: profile.null_counts_by_subject(d, "l_orderkey"), "SELECT l_orderkey AS subject_id, CAST((price IS NULL)::INT + (status IS NULL)::INT AS BIGINT) AS n FROM t")


def _flags() -> dict[str, Column]:
    return {"a": convert.wrong_type(F.col("a"), convert.parse_numeric(F.col("a"))), "b": convert.wrong_type(F.col("b"), convert.parse_year(F.col("b"))), "c": convert.wrong_type(F.col("c"), convert.parse_levels(F.col("c"), RETURNED))}


_wa, _wb, _wc = f"(({s_numeric('a')}) IS NULL)", f"(({s_year('b')}) IS NULL)", "(c NOT IN ('a', 'r'))"
add("wrong_type_by_subject", "lineitem", MIXED, lambda d: profile.wrong_type_by_subject(d, "l_orderkey", _flags()), f"SELECT l_orderkey AS subject_id, CAST(sum({_wa}::INT + {_wb}::INT + {_wc}::INT) AS BIGINT) AS n FROM t GROUP BY 1 HAVING sum({_wa}::INT + {_wb}::INT + {_wc}::INT) > 0")
add("wrong_type_by_variable", "lineitem", MIXED, lambda d: profile.wrong_type_by_variable(d, _flags()), " UNION ALL ".join(f"SELECT '{v}' AS variable, count(*) FILTER (WHERE {w}) AS n FROM t" for v, w in (("a", _wa), ("b", _wb), ("c", _wc))))
add("unique_suppression", "orders", "o_orderkey, o_orderstatus, o_custkey", lambda d: profile.shows_table(d, d.columns), " UNION ALL ".join(f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS n_unique, count(*) AS n_rows, count(DISTINCT {c}) < count(*) * (1 / 3.0::DOUBLE) AS shown FROM t" for c in ("o_orderkey", "o_orderstatus", "o_custkey")))
add("linked_date_pairs", "orders", "o_orderkey, nullif(year(o_orderdate), 1995) AS y, CAST(o_orderkey % 60 AS DOUBLE) AS age", lambda d: profile.year_pairs(d, "age", "y", F.lit(2020)), "SELECT age AS reported, CAST(2020 - y AS DOUBLE) AS computed FROM t WHERE y IS NOT NULL")
add("bmi_pairs", "lineitem", DEP, lambda d: profile.bmi_pairs(d, "x", "w", "y"), "SELECT x AS reported, w / (y * y) AS computed FROM t WHERE x IS NOT NULL AND w IS NOT NULL AND y IS NOT NULL AND y <> 0")
add("bp_pairs", "lineitem", DEP, lambda d: profile.pressure_pairs(d, "w", "x"), "SELECT w AS systolic, x AS diastolic FROM t WHERE w IS NOT NULL AND x IS NOT NULL")
_cell = lambda c: f"CASE WHEN w{c} > 0 THEN CAST(least(59, floor(({c} - l{c}) / w{c})) AS BIGINT) ELSE 0 END"
add("linked_date_grid", "orders", "o_orderkey, CAST(nullif(year(o_orderdate), 1995) AS DOUBLE) AS y, CAST(o_orderkey % 77 AS DOUBLE) AS age", lambda d: profile.grid(d, "age", "y"), f"WITH k AS (SELECT age AS a, y AS b FROM t WHERE y IS NOT NULL AND age IS NOT NULL), e AS (SELECT min(a) AS la, (max(a) - min(a)) / 60 AS wa, min(b) AS lb, (max(b) - min(b)) / 60 AS wb FROM k), p AS (SELECT {_cell('a')} AS i, {_cell('b')} AS j, la, wa, lb, wb FROM k, e) SELECT i, j, min(la) + i * min(wa) AS x, min(lb) + j * min(wb) AS y, count(*) AS n FROM p GROUP BY i, j")
add("exclusion_counts", "orders", "nullif(o_custkey, 4) AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 60 END AS age", lambda d: rows.exclusion_counts(d, "id", "age", 18), "SELECT count(*) FILTER (WHERE age IS NULL OR age < 18) AS n_age, count(*) FILTER (WHERE age >= 18 AND id IS NULL) AS n_id FROM t")
add("bounds_report", "events", "event_id, value", lambda d: rows.bounds_counts(d, {"value": {"min": 5, "max": 50}}), "SELECT 'value' AS variable, count(*) FILTER (WHERE value < 5) AS n_below, count(*) FILTER (WHERE value > 50) AS n_above, CAST(0 AS BIGINT) AS n_beyond_sd FROM t")

# ---- the whole plan ----------------------------------------------------------------------------

FLAGSHIP = """
tag: FS
globals: {min_age_for_inclusion: 16, max_invalid_datatypes_per_subject: 1}
variables:
  id: {name: id, canonical_name: subject, type: string, subject_id: true}
  age: {name: age, canonical_name: age, type: numeric, subject_age: true}
  amount: {name: amount, canonical_name: amount spent, type: numeric, bounds: {min: 1000, max: 400000}}
  placed: {name: placed, canonical_name: year placed, type: date}
  status: {name: status, canonical_name: status, type: categorical, levels: {l1: {name: open, alternate_patterns: [o]}, l2: {name: filled, alternate_patterns: [f]}}}
  bp: {name: bp, canonical_name: blood pressure, type: bp}
  priority: {name: priority, canonical_name: priority, type: string, na-values: [4-not specified]}
derived:
  share: {name: share, type: numeric, code: "amount / age"}
"""
RULE = "amount > 5000"
MESS = "concat(' ID', CAST(c_custkey AS STRING), ' ') AS id, concat(CAST(c_custkey % 70 + 1 AS STRING), CASE WHEN c_custkey % 9 = 0 THEN ' / 2' ELSE ' years' END) AS age, concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), CASE o_orderkey % 4 WHEN 0 THEN ' USD' WHEN 1 THEN '.' ELSE '' END) AS amount, CASE o_orderkey % 3 WHEN 0 THEN concat('March,', CAST(year(o_orderdate) AS STRING)) WHEN 1 THEN concat('1/2/', CAST(year(o_orderdate) AS STRING)) ELSE 'Not  Sure' END AS placed, CASE WHEN o_orderkey % 13 = 0 THEN '=#VALUE!' ELSE o_orderstatus END AS status, concat(CAST(o_orderkey % 80 + 90 AS STRING), ' - ', CAST(c_custkey % 60 + 40 AS STRING)) AS bp, o_orderpriority AS priority"


def flagship_config() -> config.Dataset:
    import yaml

    d = yaml.safe_load(FLAGSHIP)
    d["variables"]["amount"]["dependencies"] = {"d1": {"name": "plausible", "condition": RULE, "exclude_on_failure": ["status"]}}
    return config.build(config.resolve(d, {"models": {}}))


def pipeline_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    raw = o.join(c, F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey", *_split(MESS))
    res = pipeline.clean(raw.drop("o_orderkey"), flagship_config())
    return res.output.withColumn("share", F.round("share", 6))


_status = "CASE WHEN status = '=#VALUE!' THEN NULL WHEN status = 'O' THEN 'open' WHEN status = 'F' THEN 'filled' END"
_E2E = f"""WITH t AS (SELECT o_orderkey, {MESS} FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT lower(trim(id)) AS id, {s_numeric("regexp_replace(lower(age), '[^a-z0-9)}\\]]+$', '')")} AS age, age AS age_raw, CAST(regexp_extract(amount, '^[0-9]+', 0) AS DOUBLE) AS amount, CASE WHEN placed = 'Not  Sure' THEN NULL ELSE CAST(right(placed, 4) AS DOUBLE) END AS placed, {_status} AS status, CASE WHEN status NOT IN ('=#VALUE!', 'O', 'F') THEN 1 ELSE 0 END AS bad_status, replace(bp, ' - ', '/') AS bp, nullif(lower(priority), '4-not specified') AS priority FROM t),
w AS (SELECT id, sum(bad_status + CASE WHEN age IS NULL THEN 1 ELSE 0 END) AS n FROM a GROUP BY id),
b AS (SELECT id, age, CASE WHEN amount BETWEEN 1000 AND 400000 THEN amount END AS amount, placed, status, bp, priority FROM a WHERE age >= 16),
f AS (SELECT *, bool_or(coalesce(amount <= 5000, false)) OVER (PARTITION BY id) AS bad FROM b)
SELECT id, age, amount, placed, CASE WHEN NOT bad THEN status END AS status, bp, priority, round(amount / age, 6) AS share FROM f WHERE id NOT IN (SELECT id FROM w WHERE n > 1)"""
SPECIAL["pipeline_end_to_end"] = (pipeline_end_to_end, _E2E)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(q: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: q.make(table(spark, sf_dir, q.table).selectExpr(*_split(q.mess)))

    return {k: of(q) for k, q in QUERIES.items()} | {k: f for k, (f, _) in SPECIAL.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, q in QUERIES.items():
        if q.sql is None:
            continue
        mess = f"t AS (SELECT {q.mess} FROM {q.table})"
        out[k] = f"WITH {mess}, {q.sql[5:]}" if q.sql.startswith("WITH ") else f"WITH {mess} {q.sql}"
    return out | {k: s for k, (_, s) in SPECIAL.items() if s}
