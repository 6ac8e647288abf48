"""The cleaning plan: a configuration and a table of strings become lazy DataFrames.

Stages, in order: string harmonisation of all columns, consent, missing values
of each variable, types, age, missing ids, bounds, label harmonisation, derived
columns and their bounds, cross-variable rules.  Every stage is one projection or
filter; nothing runs until a result is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert, text
from ..operators import depend, labels, profile, rows
from .config import ConfigError, Dataset, Variable
from .expression import Compiled, compile_text, names, parse

_STRING_STAGE_TYPES = ("string",)


@dataclass(frozen=True)
class Audit:
    """What happened on the way, as lazy DataFrames."""

    excel: DataFrame
    unicode: DataFrame
    wrong_type: DataFrame
    rejected: DataFrame
    wrong_by_variable: DataFrame
    bounds: DataFrame | None
    consent: DataFrame | None
    ambiguous: DataFrame | None
    labels: Mapping[str, DataFrame]
    failures: DataFrame | None
    scalar: Mapping[str, DataFrame]
    excluded: DataFrame


@dataclass(frozen=True)
class Result:
    """``df`` feeds profiles and the report; ``output`` has failed rules applied and feeds the sinks."""

    cfg: Dataset
    df: DataFrame
    output: DataFrame
    audit: Audit
    rules: tuple[depend.Rule, ...] = field(default=())


def harmonize_strings(df: DataFrame, cfg: Dataset) -> DataFrame:
    """First pass, failed formulas, nonword characters and missing values: one projection."""

    def cell(v: Variable) -> Column:
        c = text.null_excel_failures(text.first_pass(F.col(v.tag)))
        if v.type is not None and v.type not in _STRING_STAGE_TYPES:
            c = text.strip_nonword(c, v.type == "numeric")
        return text.normalize_missing(c).alias(v.tag)

    return df.select(*[cell(v) for v in cfg.variables])


def excel_counts(df: DataFrame, cfg: Dataset) -> DataFrame:
    """(variable, n) of failed formulas, variables without any left out; one aggregate."""
    row = df.agg(*[F.count_if(text.is_excel_failure(text.first_pass(F.col(v.tag)))).alias(v.tag) for v in cfg.variables])
    parts = ", ".join(f"'{v.tag}', `{v.tag}`" for v in cfg.variables)
    return row.selectExpr(f"stack({len(cfg.variables)}, {parts}) AS (variable, n)").filter("n > 0")


def unicode_residue(df: DataFrame, cfg: Dataset) -> DataFrame:
    """(variable, value, n) of cells that keep characters outside ASCII after the first pass."""
    cells = df.select(*[text.null_excel_failures(text.first_pass(F.col(v.tag))).alias(v.tag) for v in cfg.variables])
    pairs = F.explode(F.array(*[F.struct(F.lit(v.tag).alias("variable"), F.col(v.tag).alias("value")) for v in cfg.variables])).alias("p")
    return cells.select(pairs).filter(text.has_unicode(F.col("p.value"))).groupBy("p.variable", "p.value").agg(F.count(F.lit(1)).alias("n"))


def typed(v: Variable) -> Column:
    """The variable's column converted by its type."""
    c = F.col(v.tag)
    if v.type == "numeric":
        return convert.parse_numeric(c)
    if v.type == "date":
        return convert.parse_year(c)
    if v.type == "bp":
        return convert.parse_pressure(c, v.undelimited_bp)
    if v.type in ("categorical", "binary", "ordinal"):
        return convert.parse_levels(c, v.levels)
    if v.type == "categorical_to_numeric":
        return convert.levels_to_numeric(c, v.levels)
    return c


def _metadata(v: Variable) -> dict:
    if v.type in ("categorical", "binary", "ordinal"):
        return {"levels": [x.name for x in v.levels], "ordered": v.type == "ordinal", "description": v.canonical_name}
    return {"description": v.canonical_name}


def derive(df: DataFrame, cfg: Dataset) -> DataFrame:
    """Adds derived columns in the order in which their inputs become known.

    Passes over the configuration repeat until none can be added; a name that
    exists already and empty code are skipped; what is left over is an error.
    """
    todo = [v for v in cfg.derived if v.tag not in df.columns and (v.code or "").strip()]
    levels = {v.tag: [x.name for x in v.levels] for v in (*cfg.variables, *cfg.derived) if v.type == "ordinal"}
    while todo:
        later = []
        for v in todo:
            if names(parse(v.code or "")) <= set(df.columns):
                made = compile_text(v.code or "", {c: F.col(f"`{c}`") for c in df.columns}, levels)
                columns = df.columns
                for name, c in made.steps:
                    df = df.withColumn(name, c)
                df = df.select(*[F.col(f"`{c}`") for c in columns], _no_nan(df, made.value).alias(v.tag))
            else:
                later.append(v)
        if len(later) == len(todo):
            raise ConfigError("derived variables cannot be resolved: " + ", ".join(v.tag for v in later))
        todo = later
    return df


def _no_nan(df: DataFrame, c: Column) -> Column:
    kind = df.select(c.alias("x")).schema["x"].dataType.typeName()
    return F.when(~F.isnan(c), c) if kind in ("double", "float") else c


def compile_rules(df: DataFrame, cfg: Dataset) -> tuple[list[depend.Rule], dict[str, Compiled]]:
    """Row rules, and by variable:key the conditions made of aggregates only."""
    columns = {c: F.col(f"`{c}`") for c in df.columns}
    levels = {v.tag: [x.name for x in v.levels] for v in cfg.variables if v.type == "ordinal"}
    rowwise, scalar = [], {}
    for v in (*cfg.variables, *cfg.derived):
        for d in v.dependencies:
            made = compile_text(d.condition, columns, levels)
            if made.steps:
                raise ConfigError(f"{v.tag}: a condition cannot need columns of its own")
            if made.rowwise:
                rowwise.append(depend.Rule(v.tag, d.key, made.value, d.name, d.exclude, d.exclude_all, d.condition))
            else:
                scalar[f"{v.tag}:{d.key}"] = made
    return rowwise, scalar


def clean(raw: DataFrame, cfg: Dataset, dictionary: DataFrame | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None, threshold: float = 0.8, discernment: float = 0.75) -> Result:
    """The whole plan; ``raw`` has the configuration's tags as columns, all strings.

    Consent lists are one-column DataFrames of ids.
    """
    sid = cfg.id_variable.tag
    strings = harmonize_strings(raw, cfg)
    allowed = rows.consent(strings, sid, include, exclude)
    nulled = allowed.select(*[text.null_values(F.col(v.tag), v.na_values, v.suppress_output).alias(v.tag) for v in cfg.variables])
    # before and after of every variable, so that the audit needs no second pass
    both = nulled.select(*[F.col(v.tag).alias(f"__before_{v.tag}") for v in cfg.variables], *[typed(v).alias(v.tag, metadata=_metadata(v)) for v in cfg.variables])
    flags = {v.tag: convert.wrong_type(F.col(f"__before_{v.tag}"), F.col(v.tag)) for v in cfg.variables}
    by_subject = profile.wrong_type_by_subject(both, sid, flags)
    entries = F.explode(F.array_compact(F.array(*[F.when(f, F.struct(F.lit(t).alias("variable"), F.col(f"__before_{t}").alias("value"))) for t, f in flags.items()]))).alias("e")
    rejected = both.select(entries).groupBy("e.variable", "e.value").agg(F.count(F.lit(1)).alias("n"))
    by_variable = profile.wrong_type_by_variable(both, flags)

    df = both.select(*[F.col(v.tag) for v in cfg.variables])
    excluded = rows.exclusion_counts(df, sid, None if cfg.min_age is None else cfg.age_variable.tag, cfg.min_age)
    if cfg.min_age is not None:
        df = rows.by_age(df, cfg.age_variable.tag, cfg.min_age)
    df = rows.by_missing_id(df, sid)
    limits = {v.tag: v.bounds for v in cfg.variables if v.bounds and v.type in ("numeric", "date", "categorical_to_numeric")}
    bounds_audit = rows.bounds_counts(df, limits) if limits else None
    df = rows.bounds(df, limits) if limits else df

    label_reports = {}
    if dictionary is not None:
        for v in cfg.variables:
            if v.label:
                label_reports[v.tag] = labels.report(df, v.tag, dictionary, threshold, discernment)
                df = labels.harmonize(df, v.tag, dictionary, threshold, discernment)

    df = derive(df, cfg)
    late = {v.tag: v.bounds for v in cfg.derived if v.bounds and v.type in ("numeric", "date") and v.tag in df.columns}
    df = rows.bounds(df, late) if late else df

    rules, scalar = compile_rules(df, cfg)
    output = depend.null_failures(df, sid, rules) if rules else df
    output = rows.by_metric(output, sid, by_subject, cfg.max_invalid)
    audit = Audit(
        excel=excel_counts(raw, cfg),
        unicode=unicode_residue(raw, cfg),
        wrong_type=by_subject,
        rejected=rejected,
        wrong_by_variable=by_variable,
        bounds=bounds_audit,
        consent=rows.consent_counts(strings, sid, include, exclude) if include is not None and exclude is not None else None,
        ambiguous=rows.consent_ambiguous(strings, sid, include, exclude) if include is not None and exclude is not None else None,
        labels=label_reports,
        failures=depend.failures(df, sid, rules) if rules else None,
        scalar={k: df.select(c.value.alias("holds")).limit(1) for k, c in scalar.items()},
        excluded=excluded,
    )
    return Result(cfg, df, output, audit, tuple(rules))


def run(spark: SparkSession, path: str, cfg: Dataset, sep: str = "\t", quote: str = "", dictionary_path: str | None = None, folder: str = "") -> Result:
    """Reads the table and the files that the configuration names, and cleans; no rows after consent is an error."""
    from ..sources import read

    at = lambda p: p if "/" in p or not folder else f"{folder}/{p}"
    raw = read.read_table(spark, path, cfg, sep, quote)
    include = read.consent_list(spark, at(cfg.include_file)) if cfg.include_file else None
    exclude = read.consent_list(spark, at(cfg.exclude_file)) if cfg.exclude_file else None
    if include is not None or exclude is not None:
        sid = cfg.id_variable.tag
        ids = harmonize_strings(raw, cfg).select(sid)
        if rows.consent(ids, sid, include, exclude).isEmpty():
            raise ConfigError("no subject is left after consent")
    dictionary = read.label_dictionary(spark, dictionary_path) if dictionary_path else None
    return clean(raw, cfg, dictionary, include, exclude)


def summaries(res: Result) -> dict[str, DataFrame]:
    """Profiles of the cleaned table: one aggregate for numbers, one shuffle for all other values."""
    kinds = dict(res.df.dtypes)
    numbers = [c for c, k in kinds.items() if k in ("double", "float", "int", "bigint")]
    sid = res.cfg.id_variable.tag
    others = [c for c in res.df.columns if c not in numbers and c != sid]
    out = {"nulls_by_subject": profile.null_counts_by_subject(res.df, sid)}
    if numbers:
        out["numeric"] = profile.numeric_summary(res.df, numbers)
    if others:
        out["values"] = profile.value_counts(res.df, others)
        out["shown"] = profile.shows_table(res.df, others)
    if res.rules:
        out["rules"] = depend.rule_report(res.df, sid, list(res.rules))
        out["failures_by_subject"] = depend.failures_by_subject(res.audit.failures)
    return out
