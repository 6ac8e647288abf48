"""Sinks: delimited text, Parquet, Stata, SAS, YAML, and a dispatcher over them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import config
from ..plans.pipeline import Result


def number_text(c: Column) -> Column:
    """A double with up to 15 significant digits, whole numbers without a point."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    digits = F.regexp_replace(F.format_string("%.15g", c), r"(\.[0-9]*?)0+(e|\z)", "$1$2")
    return F.when(whole, c.cast("long").cast("string")).when(c.isNotNull(), F.regexp_replace(digits, r"\.(e|\z)", "$1"))


def as_text(df: DataFrame) -> DataFrame:
    """All columns as the delimited sink prints them; null is NA."""
    cell = lambda c, k: number_text(F.col(f"`{c}`")) if k in ("double", "float") else F.upper(F.col(f"`{c}`").cast("string")) if k == "boolean" else F.col(f"`{c}`").cast("string")
    return df.select(*[F.coalesce(cell(c, k), F.lit("NA")).alias(c) for c, k in df.dtypes])


def write_tsv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of delimited files with headers, or one file; quotes are left as they are."""
    out = as_text(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, sep="\t", header=True, quote="\x00", escape="\x00", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _pandas(df: DataFrame):
    """A table small enough for one machine's statistics package; categories by their levels."""
    import pandas as pd

    out = df.toPandas()
    for f in df.schema:
        if "levels" in f.metadata:
            out[f.name] = pd.Categorical(out[f.name], categories=f.metadata["levels"], ordered=bool(f.metadata.get("ordered")))
        elif f.dataType.typeName() == "string":
            out[f.name] = out[f.name].fillna("")
        elif f.dataType.typeName() == "boolean":
            out[f.name] = out[f.name].astype("float64")
    return out


def write_stata(df: DataFrame, path: str) -> None:
    """One .dta file; categories become value labels.  The format is one machine's, so the rows are collected."""
    _pandas(df).to_stata(path, write_index=False, version=118, data_label="cleaned table")


def write_spss(df: DataFrame, path: str) -> None:
    try:
        import pyreadstat
    except ImportError as e:
        raise NotImplementedError("SPSS output needs the package pyreadstat, which is not installed") from e
    pyreadstat.write_sav(_pandas(df), path, compress=True)


def write_sas(df: DataFrame, data_path: str, program_path: str, name: str = "cleaned") -> None:
    """Comma-delimited data and a program that reads them, with formats for categories."""
    table = _pandas(df)
    formats, inputs, applied = [], [], []
    for f in df.schema:
        tag = f.name[:32]
        if "levels" in f.metadata:
            codes = "\n".join(f'    {i} = "{x.replace(chr(34), chr(34) * 2)}"' for i, x in enumerate(f.metadata["levels"], 1))
            formats.append(f"  value f{len(formats)}_\n{codes};")
            applied.append(f"  format {tag} f{len(formats) - 1}_.;")
            codes_of = table[f.name].cat.codes
            table[f.name] = (codes_of + 1).where(codes_of >= 0)
            inputs.append(tag)
        elif f.dataType.typeName() == "string":
            width = max(1, int(table[f.name].str.len().max() or 1))
            inputs.append(f"{tag} : ${width}.")
        else:
            inputs.append(tag)
    table.to_csv(data_path, index=False, header=False, na_rep=".", float_format="%.15g")
    program = ["proc format;", *formats, "run;", ""] if formats else []
    program += [f"data {name};", f'  infile "{data_path}" dsd lrecl=32767;', "  input", *[f"    {x}" for x in inputs], "  ;", *applied, "run;"]
    with open(program_path, "w", encoding="utf-8") as out:
        out.write("\n".join(program) + "\n")


def write(res: Result, prefix: str, tsv: bool = True, stata: bool = False, spss: bool = False, sas: bool = False, yaml: bool = False, parquet: bool = False) -> list[str]:
    """Any subset of formats under one prefix; returns the paths."""
    prefix = os.path.splitext(prefix)[0] if prefix.endswith(".html") else prefix
    done = []
    for on, suffix, f in ((tsv, ".tsv", write_tsv), (parquet, ".parquet", write_parquet), (stata, ".dta", write_stata), (spss, ".zsav", write_spss)):
        if on:
            f(res.output, prefix + suffix)
            done.append(prefix + suffix)
    if sas:
        write_sas(res.output, prefix + ".sas.csv", prefix + ".sas")
        done += [prefix + ".sas.csv", prefix + ".sas"]
    if yaml:
        config.dump(res.cfg, prefix + ".yaml")
        done.append(prefix + ".yaml")
    return done
