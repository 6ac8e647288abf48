"""Row-wise consistency predicates: boolean Columns that are never null.

A missing value passes unless the predicate says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def among(c: Column, values: Sequence[Any]) -> Column:
    """Membership that is false, not null, for a missing value; None may be a member."""
    known = [v for v in values if v is not None]
    out = F.coalesce(c.isin(*known), F.lit(False)) if known else F.lit(False)
    return out | c.isNull() if None in values else out


def depends_on_yes(dep: Column, indep: Column, yes: Sequence[Any] = ("yes",), indep_na: Sequence[Any] = (), dep_na: Sequence[Any] = ()) -> Column:
    return dep.isNull() | among(dep, dep_na) | among(indep, indep_na) | (indep.isNotNull() & among(indep, yes))


def depends_on_not_na(dep: Column, indep: Column, indep_na: Sequence[Any] = (), dep_na: Sequence[Any] = ()) -> Column:
    return dep.isNull() | among(dep, dep_na) | ~(indep.isNull() | among(indep, indep_na))


def _unless_missing(test: Column, *columns: Column) -> Column:
    out = F.coalesce(test, F.lit(False))
    for c in columns:
        out = c.isNull() | out
    return out


def less_than(dep: Column, indep: Column) -> Column:
    return _unless_missing(dep < indep, dep, indep)


def greater_than(dep: Column, indep: Column, allow_equal: bool = True) -> Column:
    return _unless_missing(dep >= indep if allow_equal else dep > indep, dep, indep)


def duplicate_of(a: Column, b: Column) -> Column:
    return _unless_missing(a == b, a, b)


def computed_bmi(bmi: Column, weight: Column, height: Column, tolerance: float) -> Column:
    return _unless_missing(F.abs(F.try_divide(weight.cast("double"), height.cast("double") * height) - bmi) <= tolerance, bmi, weight, height)


def year_fits_age(year: Column, age: Column, reference: Column | float, tolerance: float) -> Column:
    ref = reference if isinstance(reference, Column) else F.lit(reference)
    span = ref - year
    return _unless_missing((span - tolerance < age) & (age < span + tolerance), year, age, ref)
