"""Row-local cleaning of streams: the stages that need no other row.

Harmonisation of strings, missing values, types, min and max bounds, age and
missing ids work on a streaming DataFrame as they do on a table.  Bounds in
standard deviations, ranks, quantiles and rules that spread over equal ids need
the whole table and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import rows
from ..plans.config import Dataset
from ..plans.pipeline import harmonize_strings, typed


def clean_stream(raw: DataFrame, cfg: Dataset) -> DataFrame:
    """Cleans a (streaming) table of strings that has the configuration's tags as columns."""
    df = harmonize_strings(raw, cfg)
    df = df.select(*[text.null_values(F.col(v.tag), v.na_values, v.suppress_output).alias(v.tag) for v in cfg.variables])
    df = df.select(*[typed(v).alias(v.tag) for v in cfg.variables])
    if cfg.min_age is not None:
        df = rows.by_age(df, cfg.age_variable.tag, cfg.min_age)
    df = rows.by_missing_id(df, cfg.id_variable.tag)
    limits = {v.tag: {k: b for k, b in v.bounds.items() if k != "sd"} for v in cfg.variables if v.bounds}
    return rows.bounds(df, limits) if limits else df
