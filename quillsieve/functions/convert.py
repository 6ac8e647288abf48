"""Type conversion, Column to Column: what does not convert becomes null."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import match, quoted

NUMBER = r"\A(-?[0-9]+\.?[0-9]*)(?:\z| *[^ 0-9/].*\z)"
PRESSURE = r"\A([0-9]+) *[-/,] *([0-9]+)"
UNDELIMITED = r"\A[0-9]{4}[0-9]?[0-9]?\z"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
#: Two-digit years up to this one are of this century.
CENTURY = 21


@dataclass(frozen=True)
class Level:
    """A category: its name and patterns of whole cells that mean it as well."""

    name: str
    alternates: tuple[str, ...] = ()


def parse_numeric(c: Column) -> Column:
    """The leading number, if no digit or slash follows it."""
    return match(c, NUMBER, 1).try_cast("double")


def is_pressure(c: Column, trailing: bool = False, undelimited: bool = False) -> Column:
    out = c.rlike(PRESSURE + ("" if trailing else r"\z"))
    return out | c.rlike(UNDELIMITED) if undelimited else out


def parse_pressure(c: Column, undelimited: bool = False) -> Column:
    """Blood pressure as systolic/diastolic; without a delimiter by the number of digits, if allowed."""
    if undelimited:
        for first in (2, 3):
            c = F.regexp_replace(c, rf"\A([0-9]{{{first}}})([0-9]{{2,{first}}})\z", "$1/$2")
    return F.regexp_replace(match(c, PRESSURE), PRESSURE, "$1/$2")


def map_levels(c: Column, levels: Sequence[Level]) -> Column:
    """Alternates become their level's name, level by level in order.

    Alternates are joined as ^a$|^b$ and not grouped, so a pattern's own
    top-level | frees its sides from the anchors.
    """
    for level in levels:
        if level.alternates:
            pattern = "|".join(f"^{p}$" for p in level.alternates)
            name = level.name.replace("\\", "\\\\").replace("$", "\\$")
            if any("|" in p for p in level.alternates):  # only the first match is replaced
                c = F.regexp_replace(c, f"\\A([\\s\\S]*?)(?:{pattern})", f"$1{name}")
            else:
                c = F.regexp_replace(c, pattern, name)
    return c


def parse_levels(c: Column, levels: Sequence[Level]) -> Column:
    return match(map_levels(c, levels), rf"\A(?:{quoted([x.name for x in levels])})\z")


def level_rank(c: Column, levels: Sequence[Level]) -> Column:
    """Place of an ordered category among its levels, from 1."""
    return F.when(c.isNotNull(), F.nullif(F.array_position(F.array(*[F.lit(x.name) for x in levels]), c), F.lit(0)))


def levels_to_numeric(c: Column, levels: Sequence[Level]) -> Column:
    return parse_numeric(parse_levels(c, levels))


def parse_year(c: Column) -> Column:
    """The year of a date in one of four forms; years before 1800 are none."""
    four = "[0-9]{4}"
    forms = rf"\A(?:(?:{MONTHS}),?({four})|({four})|({four})-[0-9]{{2}}-[0-9]{{2}}|.*[/ -]([0-9]{{2}}|{four}))\z"
    year = F.regexp_replace(match(c, forms), forms, "$1$2$3$4")
    # two digits, with zeros before them or without, are of this century or of the last
    this = "|".join(f"{y:02}" for y in range(CENTURY + 1))
    year = F.regexp_replace(year, rf"\A(?:00)?({this})\z", "20$1")
    year = F.regexp_replace(year, r"\A(?:00)?([0-9]{2})\z", "19$1")
    return match(year, r"\A(?:1[89]|[2-9][0-9])[0-9]{2}\z").cast("double")


def wrong_type(before: Column, after: Column) -> Column:
    """A value was there and did not convert."""
    return before.isNotNull() & after.isNull()
