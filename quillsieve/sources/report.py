"""The HTML report: facts of the audit and the profiles, small aggregates only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile
from ..plans.config import ConfigError, Variable
from ..plans.pipeline import Result, summaries

ROWS = 200  #: rows of a table in the report at most; counts are complete


def table(rows: Sequence[Sequence[object]], head: Sequence[str]) -> str:
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else escape(str(x))
    body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + f"</tr>{body}</table>"


def bars(points: Sequence[tuple[float, int]], width: int = 480, height: int = 120) -> str:
    """A histogram as inline SVG."""
    if not points:
        return ""
    top, n = max(c for _, c in points) or 1, len(points)
    w = width / n
    rects = "".join(f'<rect x="{i * w:.1f}" y="{height - height * c / top:.1f}" width="{max(w - 1, 0.5):.1f}" height="{height * c / top:.1f}"><title>{x:.6g}: {c}</title></rect>' for i, (x, c) in enumerate(points))
    return f'<svg width="{width}" height="{height}" fill="steelblue">{rects}</svg>'


def grouped_bars(groups: Mapping[str, Sequence[tuple[int, float, int]]], means: Mapping[str, float], width: int = 480, height: int = 120) -> str:
    """Histograms of several groups over each other, by shares of each group, with a line at each mean."""
    cells = [c for g in groups.values() for c in g]
    if not cells:
        return ""
    last, low = max(c[0] for c in cells) + 1, min(cells)
    w, totals = width / last, {g: sum(n for *_, n in c) for g, c in groups.items()}
    top = max(n / totals[g] for g, c in groups.items() for *_, n in c)
    step = next(((x - low[1]) / (b - low[0]) for b, x, _ in cells if b != low[0]), 1.0)
    out = []
    for k, (g, c) in enumerate(sorted(groups.items())):
        colour = f"hsl({360 * k // len(groups)},60%,45%)"
        out += [f'<rect x="{b * w:.1f}" y="{height * (1 - n / totals[g] / top):.1f}" width="{max(w - 1, 0.5):.1f}" height="{height * n / totals[g] / top:.1f}" fill="{colour}" opacity="0.3"><title>{escape(g)}, {x:.6g}: {n}</title></rect>' for b, x, n in c]
        if means.get(g) is not None:
            at = w * (low[0] + (means[g] - low[1]) / step)
            out.append(f'<line x1="{at:.1f}" x2="{at:.1f}" y1="0" y2="{height}" stroke="{colour}"/><text x="{at + 3:.1f}" y="{12 * (k + 1)}" font-size="11" fill="{colour}">{escape(g)}</text>')
    return f'<svg width="{width}" height="{height}">{"".join(out)}</svg>'


def scatter(cells: Sequence[tuple[float, float, int]], across: str, up: str, side: int = 300) -> str:
    """Counts of a grid as squares, darker where more pairs lie, and the line of equal values."""
    if not cells:
        return "<p>No pairs of known values.</p>"
    low, high = min(min(x, y) for x, y, _ in cells), max(max(x, y) for x, y, _ in cells)
    scale = side / ((high - low) or 1.0)
    most = max(n for *_, n in cells)
    dots = "".join(f'<rect x="{(x - low) * scale:.1f}" y="{side - (y - low) * scale:.1f}" width="4" height="4" opacity="{0.25 + 0.75 * n / most:.2f}"><title>{x:.6g}, {y:.6g}: {n}</title></rect>' for x, y, n in cells)
    return f'<p>{escape(up)} by {escape(across)}</p><svg width="{side + 8}" height="{side + 8}" fill="steelblue"><line x1="0" y1="{side}" x2="{side}" y2="0" stroke="black"/>{dots}</svg>'


def comparisons(df: DataFrame, v: Variable) -> list[tuple[str, DataFrame]]:
    """Title and pairs of each comparison that the variable is configured with; a column that is missing is an error."""

    def need(tag: str) -> str:
        if tag not in df.columns:
            raise ConfigError(f"{v.tag}: no variable {tag} to compare with")
        return tag

    out = []
    if v.linked_date:
        year, reference = need(str(v.linked_date["reported_year"])), v.linked_date["reference_year"]
        against = F.col(f"`{need(reference)}`") if isinstance(reference, str) else F.lit(float(reference))
        out.append((f"Reported age {v.tag} and age derived from {year}", profile.year_pairs(df, v.tag, year, against)))
    if v.computed_bmi:
        weight, height = need(v.computed_bmi["weight"]), need(v.computed_bmi["height"])
        out.append((f"Reported BMI {v.tag} and BMI derived from height {height} and weight {weight}", profile.bmi_pairs(df, v.tag, weight, height)))
    if v.computed_bp_ratio:
        low = need(v.computed_bp_ratio["diastolic"])
        out.append((f"Reported systolic {v.tag} and diastolic blood pressure {low}", profile.pressure_pairs(df, v.tag, low)))
    return out


def frame(df: DataFrame, order: Sequence[str], n: int = ROWS) -> str:
    got = df.orderBy(*order).limit(n).collect()
    return table([tuple(r) for r in got], df.columns)


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def render(res: Result, unique_share: float = 1 / 3) -> str:
    """All sections; variables that are not to be reported are never collected."""
    cfg, df = res.cfg, res.df
    kinds = dict(df.dtypes)
    sid = cfg.id_variable.tag
    shown = [v for v in (*cfg.variables, *cfg.derived) if v.tag in df.columns and not v.suppress_reporting and v.tag != sid]
    made = summaries(res)
    out = [f"<h1>Data cleaning report: {escape(cfg.tag)}</h1>"]
    if res.audit.consent is not None:
        c = res.audit.consent.first()
        out.append(f"<p>Consent: {plural(c['n_initial'], 'row')} at first, {c['n_no']:,} refused, {c['n_yes']:,} agreed.</p>")
        both = res.audit.ambiguous.count()
        out.append(f"<p>{plural(both, 'subject')} on neither list, excluded as well.</p>")
    gone = res.audit.excluded.first()
    if cfg.min_age is not None:
        out.append(f"<p>{plural(gone['n_age'], 'row')} removed for an age that is unknown or below {cfg.min_age:g}.</p>")
    out.append(f"<p>{plural(gone['n_id'], 'row')} removed for lacking an id.</p>")
    kept, final = df.count(), res.output.count()
    out.append(f"<p>{plural(kept, 'row')} after exclusions by consent, age and id; {final:,} in the output after exclusion by entries of the wrong type ({kept - final:,} removed).</p>")
    out.append("<h2>Failed formulas</h2>" + frame(res.audit.excel, ["variable"]))
    hidden = [v.tag for v in cfg.variables if v.suppress_reporting]
    out.append("<h2>Characters outside ASCII</h2>" + frame(res.audit.unicode.filter(~F.col("variable").isin(*hidden)) if hidden else res.audit.unicode, ["variable", "value"]))
    out.append("<h2>Entries of the wrong type</h2>" + frame(res.audit.wrong_by_variable, ["variable"]))
    out.append("<h3>Subjects with most of them</h3>" + frame(profile.top(res.audit.wrong_type, "n", "subject_id"), ["n", "subject_id"]))
    out.append("<h3>Subjects with most missing values</h3>" + frame(profile.top(made["nulls_by_subject"], "n", "subject_id"), ["n", "subject_id"]))
    numeric = {r["variable"]: r for r in made["numeric"].collect()} if "numeric" in made else {}
    gate = {r["variable"]: r["n_unique"] < unique_share * r["n_rows"] for r in made["shown"].collect()} if "shown" in made else {}
    limits = {r["variable"]: r for r in res.audit.bounds.collect()} if res.audit.bounds is not None else {}
    rejected = res.audit.rejected
    for v in shown:
        out.append(f"<h2>{escape(v.tag)}: {escape(v.canonical_name or v.name)}</h2>")
        if v.code:
            out.append(f"<pre>{escape(v.code)}</pre>")
        if v.tag in numeric:
            out.append(table([tuple(numeric[v.tag])[1:]], profile.SUMMARY))
            points = [(r["start"], r["n"]) for r in profile.histogram(df, v.tag).orderBy("bin").collect()]
            out.append(bars(points))
            if v.multimodal and v.multimodal in df.columns:
                means = profile.group_means(df, v.tag, v.multimodal)
                groups: dict[str, list[tuple[int, float, int]]] = {}
                for r in profile.histogram(df.filter(F.col(f"`{v.multimodal}`").isNotNull()), v.tag, v.multimodal).orderBy("group", "bin").collect():
                    groups.setdefault(str(r["group"]), []).append((r["bin"], r["start"], r["n"]))
                out.append(grouped_bars(groups, {r["group"]: r["mean"] for r in means.collect()}) + frame(means, ["group"]))
            if v.tag in limits:
                b = limits[v.tag]
                out.append(table([(k, v.bounds[k], b[n]) for k, n in (("min", "n_below"), ("max", "n_above"), ("sd", "n_beyond_sd")) if k in v.bounds], ["bound", "value", "count"]))
            elif "sd" not in v.bounds:
                g = profile.sd_guides(df, v.tag).first()
                out.append(table([tuple(g)], ["mean - 3 sd", "mean + 3 sd"]))
        elif v.type in ("categorical", "binary", "ordinal"):
            out.append(frame(profile.level_counts(df, v.tag, [x.name for x in v.levels]), ["value"]))
        elif gate.get(v.tag):
            out.append(frame(made["values"].filter(F.col("variable") == v.tag).select("value", "n"), ["value"]))
        elif kinds[v.tag] == "string":
            out.append("<p>Too many unique values for a table.</p>")
        for title, pairs in comparisons(df, v):
            cells = profile.grid(pairs, *pairs.columns).orderBy("i", "j").collect()
            out.append(f"<h3>{escape(title)}</h3>" + scatter([(r["x"], r["y"], r["n"]) for r in cells], *pairs.columns))
        if v.type not in (None, "string"):
            bad = rejected.filter(F.col("variable") == v.tag).select("value", "n")
            out.append("<h3>Entries that did not convert</h3>" + frame(bad, ["value"]))
        if v.tag in res.audit.labels:
            out.append("<h3>Label matches</h3>" + frame(res.audit.labels[v.tag], ["reasoning", "label", "value"]))
        for d in v.dependencies:
            out.append(f"<p>Rule {escape(d.name)}: <code>{escape(d.condition)}</code></p>")
            for t in d.tables:
                if t in df.columns:
                    out.append(frame(profile.contingency(df, v.tag, t), ["a", "b"]))
    if "rules" in made:
        out.append("<h2>Rules</h2>" + frame(made["rules"], ["variable", "dependency"]))
    style = "<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;text-align:left}</style>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'>{style}</head><body>{''.join(out)}</body></html>"


def report(res: Result, path: str, unique_share: float = 1 / 3) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(res, unique_share))
