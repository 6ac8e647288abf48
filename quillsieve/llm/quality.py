"""Quality rules with adaptive thresholds; DataFrame functions only.

``measure`` computes counts of words, symbols, repeated lines and repeated
8-word windows.  ``thresholds`` keeps a mergeable KLL sketch of each ratio per
language and source, merges them upward (language, then all) for groups that
are too small, and turns quantiles into fences.  ``judge`` joins the fences to
the measures.  A fence lies as far outside the ``TAIL`` quantile of its side as
that lies from the median, so the spread of a group's bulk decides, and at most
``TAIL`` of a group lies beyond it.  There is no least spread: where hardly any
document has symbols or repeats, those that have them fail.

Defined results: a null text has no words; a document without words fails the
base rule; null languages and sources are groups of their own; repeated rows
get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, bounded_join, pick, scratch, words

WINDOW = 8  #: words in a window
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_GROUP = 200  #: documents from which a group's own sketch is used
TAIL = 0.05
SKETCH_K = 400
#: Ratios judged, and whether a low value counts as well.
RATIOS = {"symbol_ratio": False, "dup_line_ratio": False, "repeat_ratio": False, "mean_word": True}
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(sorted_starts: Column) -> Column:
    """Words covered by windows that start at the given sorted positions."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"))
    return F.aggregate(sorted_starts, zero, step, lambda a: a["n"])


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS``, ``n_lines`` and ``base_failed``; columns of such names are replaced.

    Windows are compared by 64-bit hashes within one document.  A document's
    arrays live in one row, never in a group; only a document with a repeated
    window sorts its window hashes.
    """
    keep = [c for c in docs.columns if c.lower() not in {*COUNTS, "n_lines", "base_failed"}]
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`") for c in keep], words(t).alias("__w"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"), F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"))
    made = ["n_symbols", "word_chars"]
    cols = lambda *more: [*[F.col(f"`{c}`") for c in keep], *made, *more]
    df = df.select(*cols(F.size("__w").alias("__n"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"), F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines")))
    made += ["__n", "n_lines", "n_dup_lines"]
    windows = F.when(F.col("__n") > WINDOW, F.transform(F.sequence(F.lit(1), F.col("__n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__h", i, WINDOW))))
    df = df.select(*cols(windows.alias("__x")))
    pairs = F.when(F.size(F.array_distinct("__x")) < F.size("__x"), F.sort_array(F.transform("__x", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = df.select(*cols(pairs.alias("__s")))
    twin = lambda e, j: (F.get("__s", j - 1)["x"] == e["x"]) | (F.get("__s", j + 1)["x"] == e["x"])
    starts = F.sort_array(F.filter(F.transform("__s", lambda e, j: F.when(F.coalesce(twin(e, j), F.lit(False)), e["i"])), lambda x: x.isNotNull()))
    df = df.select(*cols(F.coalesce(_repeat_words(starts), F.lit(0)).cast("long").alias("n_repeat_words")))
    n = F.col("__n").cast("long")
    return df.select(*[F.col(f"`{c}`") for c in keep], n.alias("n_words"), *COUNTS[1:], "n_lines", ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)).alias("base_failed"))


def ratios() -> dict[str, Column]:
    per_word = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    per_line = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {"symbol_ratio": F.col("n_symbols") / per_word, "dup_line_ratio": F.col("n_dup_lines") / per_line, "repeat_ratio": F.col("n_repeat_words") / per_word, "mean_word": F.col("word_chars") / per_word}


def thresholds(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each language and source: lower and upper fence of each ratio.

    Sketches cover all documents that pass the base rule; only sketches are
    shuffled, one for each task and group.
    """
    passed = measured.filter(~F.col("base_failed")).select(F.col(f"`{lang_col}`").alias("__lang"), F.col(f"`{source_col}`").alias("__source"), *[c.alias(k) for k, c in ratios().items()])
    own = scratch(passed.groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(k, SKETCH_K).alias(k) for k in RATIOS]), "quality-sketches")
    merged = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k, SKETCH_K).alias(k) for k in RATIOS])
    by_lang = merged(own, "__lang")
    all_ = merged(own)
    a, b, c = own.alias("a"), by_lang.alias("b"), all_.alias("c")
    joined = a.join(b, F.col("a.__lang").eqNullSafe(F.col("b.__lang"))).join(F.broadcast(c), F.lit(True))  # c is one row
    out = [F.col("a.__lang").alias(lang_col), F.col("a.__source").alias(source_col)]
    for k, low in RATIOS.items():
        sketch = F.when(F.col("a.n") >= MIN_GROUP, F.col(f"a.{k}")).when(F.col("b.n") >= MIN_GROUP, F.col(f"b.{k}")).otherwise(F.col(f"c.{k}"))
        q = F.kll_sketch_get_quantile_double(sketch, F.array(F.lit(TAIL), F.lit(0.5), F.lit(1 - TAIL)))
        out += [(2 * q[0] - q[1] if low else F.lit(float("-inf"))).alias(f"{k}_low"), (2 * q[2] - q[1]).alias(f"{k}_high")]
    return joined.select(*out)


def judge(measured: DataFrame, fences: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``measured`` with ``kept``: false where the base rule or a fence fails.

    A group without fences (none of its documents passes the base rule) has no kept rows anyway.
    """
    df = bounded_join(measured, scratch(fences, "quality-fences"), [lang_col, source_col])  # fences are small
    inside = F.lit(True)
    for k, c in ratios().items():
        inside = inside & c.between(F.col(f"{k}_low"), F.col(f"{k}_high"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return df.withColumn("kept", kept).drop(*[f"{k}_{s}" for k in RATIOS for s in ("low", "high")])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, counts, base_failed, kept) for every document."""
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col, source=source_col)
    measured = scratch(measure(rows).drop("text"), "quality-measures")
    out = judge(measured, thresholds(measured))
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, with all their columns.

    Texts are measured twice rather than kept in a table between.  A column that
    is not deterministic keeps the optimizer from moving the filter below the
    measures, where it would compute them again for every use.
    """
    names = docs.columns
    at = {c: f"__d{names.index(c)}" for c in (text_col, lang_col, source_col)}
    inner = docs.toDF(*[f"__d{i}" for i in range(len(names))])
    measured = measure(inner, at[text_col]).withColumn("__fence", F.monotonically_increasing_id())
    lean = scratch(measure(inner.select(at[text_col], at[lang_col], at[source_col]), at[text_col]).drop(at[text_col]), "quality-measures")
    out = judge(measured, thresholds(lean, at[lang_col], at[source_col]), at[lang_col], at[source_col])
    return out.filter(F.col("kept") & (F.col("__fence") >= 0)).select(*[F.col(f"__d{i}") for i in range(len(names))]).toDF(*names)
