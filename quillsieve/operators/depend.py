"""Cross-variable rules: which rows fail them, and what failure does to the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A predicate on rows that belongs to a variable."""

    variable: str
    key: str
    condition: Column
    name: str = ""
    exclude: tuple[str, ...] = ()
    exclude_all: bool = False
    text: str = ""


def failures(df: DataFrame, id_col: str, rules: Sequence[Rule]) -> DataFrame:
    """(subject_id, variable, dependency) of every row whose condition is false; one pass for all rules.

    A condition that is null neither holds nor fails.
    """
    marks = F.array(*[F.when(r.condition == F.lit(False), F.struct(F.lit(r.variable).alias("variable"), F.lit(r.key).alias("dependency"))) for r in rules])
    return df.select(F.col(f"`{id_col}`").alias("subject_id"), F.explode(F.array_compact(marks)).alias("f")).select("subject_id", "f.variable", "f.dependency")


def scalar_result(df: DataFrame, condition: Column, out: str = "holds") -> DataFrame:
    """A condition made of aggregates only: one row."""
    return df.agg(condition.alias(out))


def _targets(df: DataFrame, id_col: str, rules: Sequence[Rule]) -> Mapping[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for c in [c for c in df.columns if c != id_col] if r.exclude_all else r.exclude:
            out.setdefault(c, []).append(i)
    return out


def _flags(df: DataFrame, id_col: str, rules: Sequence[Rule]) -> DataFrame:
    """With __f0, __f1, ...: whether any row with the same id fails the rule."""
    own = df.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(r.condition == F.lit(False), F.lit(False)).alias(f"__f{i}") for i, r in enumerate(rules)])
    w = W.partitionBy(F.col(f"`{id_col}`"))
    return own.select(*[F.col(f"`{c}`") for c in df.columns], *[F.max(f"__f{i}").over(w).alias(f"__f{i}") for i in range(len(rules))])


def null_failures(df: DataFrame, id_col: str, rules: Sequence[Rule]) -> DataFrame:
    """Nulls the variables that failed rules name, for all rows that share a failing row's id."""
    targets = _targets(df, id_col, rules)
    flagged = _flags(df, id_col, rules)

    def cell(c: str) -> Column:
        hit = F.lit(False)
        for i in targets.get(c, ()):
            hit = hit | F.col(f"__f{i}")
        return F.when(~hit, F.col(f"`{c}`")) if c in targets else F.col(f"`{c}`")

    return flagged.select(*[cell(c).alias(c) for c in df.columns])


def null_counts(df: DataFrame, id_col: str, rules: Sequence[Rule]) -> DataFrame:
    """One row: cells newly null and cells that could have become so."""
    targets = list(_targets(df, id_col, rules))
    after = null_failures(df, id_col, rules)
    n = lambda d, out: d.agg(F.count(F.lit(1)).alias(f"{out}_rows"), sum((F.count(F.col(f"`{c}`")) for c in targets), F.lit(0)).alias(out))
    both = n(df, "before").crossJoin(n(after, "after"))  # two single rows
    return both.select((F.col("before") - F.col("after")).alias("n_new_null"), (F.col("before_rows") * len(targets)).cast("long").alias("n_possible"))


def failures_by_subject(failed: DataFrame) -> DataFrame:
    """Variables with a failed rule for each subject."""
    return failed.groupBy("subject_id").agg(F.countDistinct("variable").alias("n"))


def failed_ids(df: DataFrame, id_col: str, rules: Sequence[Rule]) -> DataFrame:
    """(variable, dependency, subject_id, n_rows): every failing id of every rule, with its number of failing rows."""
    return failures(df, id_col, rules).groupBy("variable", "dependency", "subject_id").agg(F.count(F.lit(1)).alias("n_rows"))


def rule_report(df: DataFrame, id_col: str, rules: Sequence[Rule], ids: int = 50) -> DataFrame:
    """(variable, dependency, n_failures, ids): counts of failing rows, and the first failing ids in order.

    At most ``ids`` ids are listed for a rule (a report's length, not a limit of the counts);
    ``failed_ids`` has them all.
    """
    failed = failures(df, id_col, rules)
    n = failed.groupBy("variable", "dependency").agg(F.count(F.lit(1)).alias("n_failures"))
    first = failed.distinct().withColumn("__r", F.row_number().over(W.partitionBy("variable", "dependency").orderBy("subject_id"))).filter(F.col("__r") <= ids)
    lists = first.groupBy("variable", "dependency").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("subject_id")), lambda x: x.cast("string"))).alias("ids"))
    return n.join(lists, ["variable", "dependency"])
