import warnings

import pytest
import yaml
from pyspark.sql import functions as F

from quillsieve.plans import config, pipeline
from quillsieve.plans.config import ConfigError
from quillsieve.plans.expression import ExpressionError, compile_text, names, parse
from quillsieve.sources import forms, read, report, write
from quillsieve.streaming.rows import clean_stream

DATASET = """
tag: BO
globals: {min_age_for_inclusion: 21, max_invalid_datatypes_per_subject: 8, consent_inclusion_file: yes.txt, consent_exclusion_file: no.txt}
variables:
  BO1: {name: crew no, type: string, canonical_name: crew number, subject_id: true}
  BO2: {name: load, type: numeric, canonical_name: load in tons, bounds: {max: 45}, dependencies: {d1: {name: light, condition: "BO2 < 30", exclude_on_failure: [BO10], table_comparisons: [BO6]}}}
  BO3: {name: coat, shared_model: coat, canonical_name: coat of paint}
  BO4: {name: built, type: date, canonical_name: year of building}
  BO5: {name: age, type: numeric, canonical_name: age, subject_age: true}
  BO6: {name: licence, shared_model: licence, canonical_name: licence}
  BO7: {name: gauge, type: bp, canonical_name: pressure}
  BO8: {name: zone, shared_model: zone, canonical_name: zone}
  BO9: {name: "Home tribe", type: string, canonical_name: group, subject_ancestry: true}
  BO10: {name: remark, type: string, canonical_name: remark, suppress_reporting: true}
derived:
  D2: {name: twice the rest, type: numeric, code: "D1 * 2"}
  D1: {name: thrice the load, type: numeric, code: "BO2 * 3", bounds: {max: 60}}
"""
MODELS = """
models:
  coat: {type: categorical, levels: {l1: {name: red, alternate_patterns: [r]}, l2: {name: blue, alternate_patterns: [b]}}}
  licence: {type: categorical, levels: {l1: {name: lapsed}, l2: {name: held}}}
  zone: {type: categorical_to_numeric, levels: {l1: {name: "5", alternate_patterns: [a]}, l2: {name: "7", alternate_patterns: [b]}, l3: {name: "9", alternate_patterns: [c]}}}
"""
TABLE = [
    ["crew no", "load", "coat", "built", "age", "licence", "gauge", "zone", "Home tribe", "remark", ""],
    [" C01 ", "12", "Red", "03-2011", "21", "held", "121/77", "A", "delta", 'old "rope', "x"],
    ["c02", "17 tons", "b", "2014", "40", "lapsed", "133 - 81", "b", "Harbor", "tallow", "x"],
    ["c03", "35", "blue", "1987", "33", "held", "133", "b", "island", "oakum", "x"],
    ["c04", "NA", "red", "1979", "52", "maybe", "#VALUE!", "c", "island", "tar†paper", "x"],
    ["c05", "41", "red", "1979", "52", "lapsed", "118/70", "c", "reefs", "twine", "x"],
    ["c06", "49", "blue", "1968", "61", "held", "118/70", "b", "island", "canvas", "x"],
    ["c07", "49", "blue", "1968", "12", "held", "118/70", "b", "island", "pitch", "x"],
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("clean")
    (d / "data.tsv").write_text("\n".join("\t".join(r) for r in TABLE) + "\n", encoding="utf-8")
    (d / "dataset.yaml").write_text(DATASET)
    (d / "models.yaml").write_text(MODELS)
    (d / "yes.txt").write_text("C01\nc02\nc03 trailing\nc04\nc07\n")
    (d / "no.txt").write_text("c05\n")
    (d / "labels.txt").write_text("Delta [Deltan]\nHarbour\nIsland\n")
    return d


@pytest.fixture(scope="module")
def result(spark, folder):
    cfg = config.load(str(folder / "dataset.yaml"), str(folder / "models.yaml"))
    return pipeline.run(spark, str(folder / "data.tsv"), cfg, dictionary_path=str(folder / "labels.txt"), folder=str(folder))


def test_end_to_end(result, folder):
    got = {r.BO1: r.asDict() for r in result.output.collect()}
    assert sorted(got) == ["c01", "c02", "c03", "c04"]
    assert got["c01"] | {} == {"BO1": "c01", "BO2": 12.0, "BO3": "red", "BO4": 2011.0, "BO5": 21.0, "BO6": "held", "BO7": "121/77", "BO8": 5.0, "BO9": "delta", "BO10": 'old "rope', "D1": 36.0, "D2": 72.0}
    assert got["c02"]["BO9"] == "harbour" and got["c02"]["BO7"] == "133/81" and got["c02"]["BO3"] == "blue"
    assert got["c03"]["BO7"] is None and got["c03"]["D1"] is None and got["c03"]["D2"] == 210.0  # bounds follow derivation
    assert got["c03"]["BO10"] is None and got["c02"]["BO10"] == "tallow"  # 35 is not under 30
    assert got["c04"]["BO2"] is None and got["c04"]["BO10"] == "tar†paper" and got["c04"]["BO6"] is None
    assert {r.BO1: r.BO10 for r in result.df.collect()}["c03"] == "oakum"  # before rules


def test_audit(result):
    assert {r.variable: r.n for r in result.audit.excel.collect()} == {"BO7": 1}
    assert [(r.variable, r.value) for r in result.audit.unicode.collect()] == [("BO10", "tar†paper")]
    assert {r.variable: r.n for r in result.audit.wrong_by_variable.filter("n > 0").collect()} == {"BO6": 1, "BO7": 1}
    assert tuple(result.audit.consent.first()) == (7, 1, 5)
    assert [r[0] for r in result.audit.ambiguous.collect()] == ["c06"]
    assert [(r.subject_id, r.dependency) for r in result.audit.failures.collect()] == [("c03", "d1")]
    assert result.df.schema["BO3"].metadata["levels"] == ["red", "blue"]


def test_report_and_sinks(result, folder):
    html = report.render(result)
    assert "light" in html and "BO2" in html and "rope" not in html  # suppressed text is not shown
    done = write.write(result, str(folder / "out.html"), stata=True, sas=True, yaml=True, parquet=True)
    assert len(done) == 6
    import glob

    import pandas as pd

    lines = [x for f in sorted(glob.glob(str(folder / "out.tsv" / "part-*"))) for x in open(f, encoding="utf-8").read().splitlines()]
    assert lines[0].split("\t")[:2] == ["BO1", "BO2"]
    rows = {x.split("\t")[0]: x.split("\t") for x in lines if not x.startswith("BO1\t")}
    assert rows["c01"][1] == "12" and rows["c04"][1] == "NA" and rows["c01"][9] == 'old "rope'
    assert len(pd.read_stata(folder / "out.dta")) == 4
    assert "proc format" in (folder / "out.sas").read_text() and len((folder / "out.sas.csv").read_text().splitlines()) == 4
    again = yaml.safe_load((folder / "out.yaml").read_text())
    assert again["variables"]["D1"]["name"] == "D1" and again["variables"]["BO1"]["original.name"] == "crew no"
    with pytest.raises(NotImplementedError):
        write.write(result, str(folder / "out2"), tsv=False, spss=True)


def test_number_text(spark):
    values = [16.0, 0.1, 1e7, -2.5, 123456789.123456, 1e-7, None, 1e20, 100.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").coalesce(1).select(write.number_text(F.col("x"))).collect()]
    assert got == ["16", "0.1", "10000000", "-2.5", "123456789.123456", "1e-07", None, "1e+20", "100"]


def test_stream(spark, folder):
    cfg = config.load(str(folder / "dataset.yaml"), str(folder / "models.yaml"))
    raw = read.read_table(spark, str(folder / "data.tsv"), cfg)
    raw.write.mode("overwrite").parquet(str(folder / "stream"))
    q = clean_stream(spark.readStream.schema(raw.schema).parquet(str(folder / "stream")), cfg).writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.BO1 for r in spark.table("cleaned").collect()) == ["c01", "c02", "c03", "c04", "c05", "c06"]


def test_config_errors(folder, spark):
    d, m = yaml.safe_load(DATASET), yaml.safe_load(MODELS)
    with pytest.raises(ConfigError, match="shared model"):
        config.resolve(d | {"variables": {"X": {"name": "x", "shared_model": "none"}}}, m)
    with pytest.raises(ConfigError, match="models"):
        config.resolve(d, {})
    with pytest.raises(ConfigError, match="unknown type"):
        config.variable("X", {"type": "odd"})
    with pytest.raises(ConfigError, match="levels"):
        config.variable("X", {"type": "ordinal"})
    cfg = config.build(config.resolve(d, m))
    with pytest.raises(ConfigError, match="differ"):
        read.bind_header([r.upper() for r in TABLE[0]], cfg)
    with pytest.raises(ConfigError, match="columns"):
        read.bind_header(["a"], cfg)
    bad = config.build(config.resolve(d | {"derived": {"D9": {"name": "x", "code": "NOPE + 1"}}}, m))
    with pytest.raises(ConfigError, match="D9"):
        pipeline.derive(spark.createDataFrame([("a",)], "BO1 string"), bad)
    (folder / "no.txt").rename(folder / "no.bak")
    (folder / "no.txt").write_text("c01\nc02\nc03\nc04\nc07\n")
    with pytest.raises(ConfigError, match="no subject"):
        pipeline.run(spark, str(folder / "data.tsv"), cfg, folder=str(folder))
    (folder / "no.bak").rename(folder / "no.txt")


def test_merge():
    assert config.merge({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    assert config.merge({"bounds": {"min": 1}}, {"bounds": {"max": 2}}) == {"bounds": {"max": 2}}  # single entries replace
    assert config.merge({"l": [1, 2]}, {"l": [3]}) == {"l": [3]}


def test_validation(folder, tmp_path):
    assert len(config.validate(str(folder / "dataset.yaml").replace("dataset", "dataset"), str(folder / "models.yaml"))) == 2
    d = yaml.safe_load(DATASET)
    d["variables"]["BO3"] = {"name": "x", "shared-model": "coat", "canonical_name": "y"}
    (tmp_path / "bad.yaml").write_text(yaml.safe_dump(d))
    with pytest.raises(ConfigError, match="shared-model"):
        config.validate(str(tmp_path / "bad.yaml"), str(folder / "models.yaml"))
    (tmp_path / "models.yaml").write_text("models: {x: {levels: {}}}")
    with pytest.raises(ConfigError, match="type"):
        config.validate(str(folder / "dataset.yaml"), str(tmp_path / "models.yaml"))


# ---- expressions --------------------------------------------------------------


@pytest.mark.parametrize(
    "code, want",
    [
        ("a + 2 * b ^ 2", [9.0, None, 21.0]),
        ("-b ^ 2", [-4.0, -1.0, -9.0]),
        ("ifelse(is.na(a), 0, a)", [1.0, 0.0, 3.0]),
        ("a %in% c(1, 3)", [True, False, True]),
        ("!(s == 'x') & b > 1", [False, False, True]),
        ("x <- a\nx[is.na(x)] <- b[is.na(x)] + 10\nx", [1.0, 11.0, 3.0]),
        ("response.is.less.than(a, b)", [True, True, False]),
        ("pkg::response.depends.on.yes(s, t, yes.al = c('p', 'q'))", [True, True, False]),
        ("stringr::str_replace(s, '(x)', '<\\\\1>')", ["<x>", None, "y"]),
        ("a / 0", [None, None, None]),
        ("rep(NA, length(a))", [None, None, None]),
        ("all(b > 0)", [True, True, True]),
        ("b - mean(b)", [0.0, -1.0, 1.0]),
        ("year.is.consistent.with.age(2000, a * 10, 2010, 5) # near", [True, True, False]),
        ("derive.rank.normal.transform(b, strat = list(u))", [0.0, -1.0, 1.0]),
    ],
)
def test_expressions(spark, code, want):
    df = spark.createDataFrame([(1, 1.0, 2.0, "x", "p", "g"), (2, None, 1.0, None, "q", "g"), (3, 3.0, 3.0, "y", "r", "g")], "i int, a double, b double, s string, t string, u string").coalesce(1)
    made = compile_text(code, {c: F.col(c) for c in df.columns})
    for n, c in made.steps:
        df = df.withColumn(n, c)
    got = [r.y for r in df.select("i", made.value.alias("y")).orderBy("i").collect()]
    if "rank" in code:
        assert got == pytest.approx([0.0, -0.9674216, 0.9674216], abs=1e-6)
    else:
        assert got == want


def test_expression_errors_and_names(spark):
    for bad in ("nope + 1", "a +", "system('ls')", "a b", "", "a[1]", "response.is.less.than(a, zz = a)", "@"):
        with pytest.raises(ExpressionError):
            compile_text(bad, {"a": F.lit(1)})
    assert names(parse("x <- a + b\ny[x > 1] <- c\nx * d")) == {"a", "b", "c", "d", "y"}
    assert not compile_text("all(a > 1)", {"a": F.lit(1)}).rowwise and compile_text("a > mean(a)", {"a": F.lit(1)}).rowwise


def test_ordinal_comparison(spark):
    df = spark.createDataFrame([("lo",), ("hi",), (None,)], "o string").coalesce(1)
    c = compile_text("o < 'hi'", {"o": F.col("o")}, {"o": ["lo", "mid", "hi"]}).value
    assert [r[0] for r in df.select(c).collect()] == [True, False, None]


# ---- forms ----------------------------------------------------------------------

SURVEY = [
    ("start", "starttime", ""), ("text", "pid", "id"), ("integer", "age", "Age"), ("note", "n1", "read this"), ("select_one fruit", "fav", "Favourite"),
    ("select_multiple fruit", "many", "Several"), ("begin repeat", "kids", "Children"), ("text", "kid", "Name"), ("integer", "kidage", "Age of child"), ("end repeat", None, None), ("decimal", "tribe_h", "Height in tribe"),
]
SURVEY = [dict(zip(("type", "name", "label"), r, strict=True)) for r in SURVEY]
CHOICES = [dict(zip(("list_name", "value", "label"), r, strict=True)) for r in [("fruit", "1.0", "Apple"), ("fruit", "2", "Pear (ripe)"), ("fruit", "2", "again"), ("solo", "1", "One"), ("solo", "9", "Prefer not to answer"), ("solo", "A|B", "Both"), (None, None, None)]]
HEAD = ["SubmissionDate", "starttime", "pid", "age", "fav", "many", "many_1", "many_2", "kids_count", "kid_1", "kidage_1", "kid_2", "kidage_2", "tribe_h", "instanceID", "KEY"]


def test_form():
    dataset, models = forms.compile_form(SURVEY, CHOICES, HEAD, "AB")
    v = dataset["variables"]
    assert [x["name"] for x in v.values()] == [h.replace("tribe", "ancestry") for h in HEAD]
    assert v["AB00003"]["subject_id"] and v["AB00004"]["subject_age"] and v["AB00006_1"]["shared_model"] == "yesno"
    assert v["AB00007_count"]["type"] == "numeric" and "AB00008_2" in v and v["AB00009_2"]["canonical_name"].endswith("repeat observation 2")
    assert models["models"]["solo"]["na-values"] == ["9"] and models["models"]["solo"]["levels"]["lvl2"]["alternate_patterns"] == ["a\\|b"]
    assert not config.violations(dataset, config.DATASET_SCHEMA) and not config.violations(models, config.MODELS_SCHEMA)
    with pytest.raises(ConfigError, match="does not yield"):
        forms.compile_form(SURVEY, CHOICES, [*HEAD, "extra"], "AB")
    with pytest.raises(ConfigError, match="does not have"):
        forms.compile_form([*SURVEY, {"type": "text", "name": "more", "label": ""}], CHOICES, HEAD, "AB")
    with pytest.raises(ConfigError, match="order"):
        forms.compile_form(SURVEY, CHOICES, [HEAD[0], HEAD[2], HEAD[1], *HEAD[3:]], "AB")
    with pytest.raises(ConfigError, match="subject_id"):
        forms.compile_form(SURVEY, CHOICES, HEAD, "AB", id_name="nobody")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        forms.variables_of({"type": "alien", "name": "x", "label": ""}, {}, "T")
    assert len(w) == 1


def test_expand(tmp_path):
    old, _ = forms.compile_form(SURVEY, CHOICES, [h for h in HEAD if not h.endswith("_2") or h == "many_2"], "AB")
    new, _ = forms.compile_form(SURVEY, CHOICES, HEAD, "NEW")
    out = forms.expand(old, HEAD, new)
    assert [x["name"] for x in out["variables"].values()] == [h.replace("tribe", "ancestry") for h in HEAD]
    assert "AB00008_2" in out["variables"] and set(old["variables"]) <= set(out["variables"])
    with pytest.raises(ConfigError, match="fits nothing"):
        forms.expand(old, ["odd", *HEAD], new)
    for name, rows in (("survey", SURVEY), ("choices", CHOICES)):
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(rows[0]), *[",".join(x or "" for x in r.values()) for r in rows]]))
    (tmp_path / "export.csv").write_text(",".join(HEAD) + "\n")
    forms.compile_files(str(tmp_path), str(tmp_path / "export.csv"), "AB", str(tmp_path / "d.yaml"), str(tmp_path / "m.yaml"))
    forms.expand_files(str(tmp_path / "d.yaml"), str(tmp_path / "e.yaml"), str(tmp_path / "export.csv"), str(tmp_path))
    assert len(config.validate(str(tmp_path / "e.yaml"), str(tmp_path / "m.yaml"))) == 2


def test_xlsx(tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "f.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="survey" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>type</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>text</t></is></c><c r="C2"><v>5</v></c></row><row><c r="C3"><v>6</v></c></row></sheetData></worksheet>')
    assert read.form_sheet(str(tmp_path / "f.xlsx"), "survey") == [{"type": "text", "name": "5"}, {"type": None, "name": "6"}]
    with pytest.raises(ConfigError):
        read.form_sheet(str(tmp_path / "f.xlsx"), "none")


def test_derived_types():
    """A derived variable has any type in any case but the one that needs raw levels."""
    d = yaml.safe_load(DATASET)
    for kind, good in (("Numeric", True), ("blood pressure", True), ("BP", True), ("categorical_to_numeric", False), ("other", False)):
        d["derived"]["D1"]["type"] = kind
        assert (not config.violations(d, config.DATASET_SCHEMA)) == good, kind
    d["derived"]["D1"]["type"], d["variables"]["BO2"]["type"] = "numeric", "Categorical_To_Numeric"
    assert not config.violations(d, config.DATASET_SCHEMA)


def test_plan_grows_with_the_variables(spark):
    """Each stage holds its input once, so plans are in proportion to the variables and generated code compiles."""
    sizes = []
    for n in (10, 200):
        kinds = ("numeric", "date", "bp", "string")
        d = {"tag": "V", "globals": {"min_age_for_inclusion": 1}, "variables": {"V0": {"name": "id", "type": "string", "canonical_name": "id", "subject_id": True}, "V1": {"name": "age", "type": "numeric", "canonical_name": "age", "subject_age": True}, **{f"V{i}": {"name": f"v{i}", "type": kinds[i % 4], "canonical_name": f"v{i}", "na-values": ["x"]} for i in range(2, n)}}}
        cfg = config.build(config.resolve(d, {"models": {}}))
        raw = spark.range(3).select(*[F.col("id").cast("string").alias(v.tag) for v in cfg.variables])
        plan = pipeline.clean(raw, cfg).df._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("regexp_"))
    assert sizes[1] < 25 * sizes[0] and sizes[1] < 200 * 60


def test_dictionary():
    assert parse_ok("Label One [Alt-A, alt  b]") == [("label one", "label one", 0), ("alt-a", "label one", 1), ("alt b", "label one", 2)]
    for bad in (["a:::b"], ["a", "A"]):
        with pytest.raises(ConfigError):
            read.parse_dictionary(bad)


def parse_ok(line):
    return read.parse_dictionary([line])
