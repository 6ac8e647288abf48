"""String cleaning, Column to Column; every function passes null through."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes that mean the same to Java's and to RE2's regular expressions.
SPACE = r"[\t-\r\x{85}\p{Z}]"
WORD = r"\p{L}\p{M}\p{N}\p{Pc}"

# Characters and what stands for them in cleaned text, applied after lower-casing.
UNICODE_REPLACEMENTS = (
    ("\u00b1", "+/-"),
    ("\u2192", "->"),
    ("\U0001f645", "#error!"),
    ("\u00b0", "degrees"),
    ("\u0394", "Delta"),
    ("\u2206", "Delta"),
    ("\u2018", "'"),
    ("\u2019", "'"),
    ("\u201c", '"'),
    ("\u201d", '"'),
    ("\u2070", "0"),
    ("\u00b2", "2"),
    ("\u00b3", "3"),
    ("\u00b9", "1"),
    ("\u2715", "x"),
    ("\u00d7", "x"),
    ("\u00e7", "c"),
    ("\u2022", "*"),
    ("\u2028", ""),
    ("\u2029", ""),
    ("\u202a", ""),
    ("\u202b", ""),
    ("\u202c", ""),
    ("\u202d", ""),
    ("\u202e", ""),
    ("\u202f", ""),
    ("\ufeff", ""),
    ("\U0001f4af", "100"),
    ("\u00a3", ""),
    ("\u00f9", "u"),
    ("\u20a9", ""),
    ("\ufe64", ""),
    ("\u00e0", "a"),
    ("\u00e8", "e"),
    ("\u200e", ""),
    ("\u00f1", "n"),
    ("\u2153", "1/3"),
    ("\u215c", "3/8"),
    ("\u2026", "..."),
    ("\u2079", "9"),
    ("\u207f", "n"),
    ("\u00ae", ""),
    ("\u2713", ""),
    ("\u1d50", "m"),
    ("\u141f", "/"),
    ("\u2e0d", "/"),
    ("\u2039", "<"),
    ("\u203a", ">"),
    ("\u2105", "%"),
    ("\u2248", "~="),
    ("\u2013", "-"),
    ("\u2014", "-"),
)
# Whole cells that spreadsheets leave for failed formulas.
EXCEL_FAILURE = r"=?#(?:div/0!|DIV/0!|error!|ERROR!|value!|VALUE!)"
EXCEL_FAILURES = rf"\A{EXCEL_FAILURE}\z"
# Whole cells that mean a missing value.
MISSING_PATTERNS = (
    r"n[/]?a",
    r"not a[pl]+ica[ble]+[,:;]*",
    r"nil",
    r"",
    r"not sure",
    r"nan",
    r"not a[s]+e[s]+ed",
    r"unav[ai]+la[bl]+e",
    r"u[nk]+[ow]+n",
    r"not av[ai]+la[bl]+e",
    r"not done",
)
MISSING = r"\A(?:" + "|".join(MISSING_PATTERNS) + r")\z"


def match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, null where there is none; ``c`` stands in it once, so chains of such steps stay linear."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def unless(c: Column, pattern: str) -> Column:
    """Null where the whole value matches."""
    return match(c, rf"\A(?!(?:{pattern})\z)[\s\S]*\z")


def quoted(values: Sequence[str]) -> str:
    """A pattern of literal values."""
    return "|".join("\\Q" + v.replace("\\E", "\\E\\\\E\\Q") + "\\E" for v in values)


def lowercase(c: Column) -> Column:
    return F.lower(c)


def squish(c: Column) -> Column:
    """One space for each run of white space, none at the ends, none around dashes; runs of dashes are one."""
    c = F.regexp_replace(F.regexp_replace(c, SPACE + "+", " "), r"\A | \z", "")
    return F.regexp_replace(c, "[ -]*-[ -]*", "-")


def collapse_repeats(c: Column, targets: Sequence[str] = ("\\\\/", "\\."), replacements: Sequence[str] = ("/", ".")) -> Column:
    """Each run of a target's characters becomes its replacement, in order."""
    if len(targets) != len(replacements):
        raise ValueError("targets and replacements differ in number")
    for t, r in zip(targets, replacements, strict=True):
        c = F.regexp_replace(c, f"[{t}]+", r.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def map_unicode(c: Column, table: Sequence[tuple[str, str]] = UNICODE_REPLACEMENTS) -> Column:
    """Replaces characters by the table.

    No output holds an input of the table, so the order of replacements makes no
    difference: one pass for single characters and deletions, one for each longer output.
    """
    single = [(a, b) for a, b in table if len(a) == 1 and len(b) <= 1]
    ordered = sorted(single, key=lambda x: not x[1])  # deletions come last
    c = F.translate(c, "".join(a for a, _ in ordered), "".join(b for _, b in ordered))
    for a, b in table:
        if len(a) != 1 or len(b) > 1:
            c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_excel_failure(c: Column) -> Column:
    return F.coalesce(c.rlike(EXCEL_FAILURES), F.lit(False))


def null_excel_failures(c: Column) -> Column:
    return unless(c, EXCEL_FAILURE)


def has_unicode(c: Column) -> Column:
    """A character outside U+0001 to U+007F is left."""
    return F.coalesce(c.rlike(r"[^\x01-\x7f]"), F.lit(False))


def leading_decimal(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\.([0-9]+)[ %a-zA-Z-]*\z", "0.$1")


def compare_words(c: Column) -> Column:
    c = F.regexp_replace(c, rf"\A *> *([{WORD}]+)", "greater than $1")
    return F.regexp_replace(c, rf"\A *< *([{WORD}]+)", "less than $1")


def negatives_to_na(c: Column) -> Column:
    return F.regexp_replace(c, r"\A *- *[0-9]+.*\z", "na")


def strip_edges(c: Column) -> Column:
    """Without nonword characters at the ends; closing brackets at the end stay."""
    return F.regexp_replace(c, rf"\A[^{WORD}]+|[^{WORD}]*[^{WORD})}}\]]\z", "")


def strip_nonword(c: Column, numeric: bool = False) -> Column:
    """What columns of any type but string go through."""
    return strip_edges(negatives_to_na(compare_words(leading_decimal(c) if numeric else c)))


def normalize_missing(c: Column) -> Column:
    return unless(c, "|".join(MISSING_PATTERNS))


def null_values(c: Column, values: Sequence[str] = (), suppress: bool = False) -> Column:
    """Exact members of ``values`` become null; all values if suppressed."""
    if suppress:
        return F.lit(None).cast("string")
    return unless(c, quoted(values)) if values else c


def vocabulary(c: Column) -> Column:
    """The older words for ancestry give way to the current ones."""
    return F.regexp_replace(F.regexp_replace(c, "(?i)tribes", "ancestries"), "(?i)tribe", "ancestry")


def first_pass(c: Column) -> Column:
    """What every column goes through before anything else."""
    return map_unicode(collapse_repeats(squish(lowercase(c))))
