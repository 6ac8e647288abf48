"""Derived values: family history, the inverse normal distribution, edit similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words that name a first-degree relative.
RELATIVES = r"\A(?:mother|father|brother|sister|sibling['s]*|parent['s]*|son['s]*|daughter['s]*|child[ren]*)\z"

# Coefficients of the rational approximations in algorithm AS 241 (Wichura 1988), constant term first.
CENTRE_A = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
CENTRE_B = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
TAIL_C = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4)
TAIL_D = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
FAR_E = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
FAR_F = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def first_degree(c: Column) -> Column:
    """yes or no: one of the listed relatives, separated by , : or ;, is of the first degree."""
    hit = F.exists(F.split(c, "[:,;]"), lambda t: F.regexp_replace(t, r"[\t-\r\x{85}\p{Z}]", "").rlike(RELATIVES))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(hit, F.lit("yes")).otherwise(F.lit("no"))


def _poly(x: str, k: tuple[float, ...]) -> str:
    out = f"{k[-1]!r}D"
    for a in reversed(k[:-1]):
        out = f"({out} * {x} + {a!r}D)"
    return out


def normal_quantile_sql(p: str, double_suffix: str = "D") -> str:
    """SQL text of the standard normal quantile; null outside 0 to 1."""
    q = f"({p} - 0.5D)"
    r = f"(0.180625D - {q} * {q})"
    t = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1.0D - {p} END))"
    near, far = f"({t} - 1.6D)", f"({t} - 5.0D)"
    body = f"""CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL
      WHEN abs({q}) <= 0.425D THEN {q} * {_poly(r, CENTRE_A)} / {_poly(r, CENTRE_B)}
      WHEN {t} <= 5.0D THEN sign({q}) * {_poly(near, TAIL_C)} / {_poly(near, TAIL_D)}
      ELSE sign({q}) * {_poly(far, FAR_E)} / {_poly(far, FAR_F)} END"""
    import re

    return body if double_suffix == "D" else re.sub(r"(?<=[0-9])D\b", double_suffix, body)


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile, inside generated code; null outside 0 to 1."""

    def poly(x: Column, k: tuple[float, ...]) -> Column:
        out = F.lit(k[-1])
        for a in reversed(k[:-1]):
            out = out * x + F.lit(a)
        return out

    q = p - 0.5
    r = F.lit(0.180625) - q * q
    t = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1.0 - p)))
    near, far = t - 1.6, t - 5.0
    tail = F.when(t <= 5.0, poly(near, TAIL_C) / poly(near, TAIL_D)).otherwise(poly(far, FAR_E) / poly(far, FAR_F))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * poly(r, CENTRE_A) / poly(r, CENTRE_B)).otherwise(F.signum(q) * tail))


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


def similarity(a: str, b: str) -> float:
    most = max(len(a), len(b))
    return 1.0 - osa_distance(a, b) / most if most else 1.0


@F.pandas_udf(DoubleType())
def osa_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
