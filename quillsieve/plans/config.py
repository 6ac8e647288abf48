"""Configuration: YAML files to frozen descriptions of a dataset's variables."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml

from ..functions.convert import Level


class ConfigError(ValueError):
    """A configuration that does not make sense."""


TYPES = ("string", "categorical", "binary", "ordinal", "numeric", "bp", "date", "categorical_to_numeric")
_PRESSURE = re.compile(r"blood[ _]?pressure|bp", re.I)


def merge(base: Any, over: Any) -> Any:
    """Settings of ``over`` on top of ``base``.

    Named entries merge by name, but only if either side has more than one
    entry; otherwise, and for lists and scalars, ``over`` replaces.
    """
    if not isinstance(base, Mapping) or not isinstance(over, Mapping):
        return over
    out = dict(base)
    size = lambda x: len(x) if isinstance(x, (Mapping, list)) else 1
    for k, v in over.items():
        if out.get(k) is not None and (size(out[k]) > 1 or size(v) > 1):
            out[k] = merge(out[k], v)
        else:
            out[k] = v
    return out


@dataclass(frozen=True)
class Dependency:
    key: str
    name: str
    condition: str
    tables: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_all: bool = False


@dataclass(frozen=True)
class Variable:
    tag: str
    name: str
    canonical_name: str = ""
    type: str | None = None
    levels: tuple[Level, ...] = ()
    na_values: tuple[str, ...] = ()
    bounds: Mapping[str, float] = field(default_factory=dict)
    undelimited_bp: bool = False
    suppress_reporting: bool = False
    suppress_output: bool = False
    subject_id: bool = False
    subject_age: bool = False
    label: bool = False
    multimodal: str | None = None
    linked_date: Mapping[str, Any] | None = None
    computed_bmi: Mapping[str, str] | None = None
    computed_bp_ratio: Mapping[str, str] | None = None
    dependencies: tuple[Dependency, ...] = ()
    code: str | None = None


@dataclass(frozen=True)
class Dataset:
    tag: str
    min_age: float | None
    max_invalid: int | None
    include_file: str | None
    exclude_file: str | None
    variables: tuple[Variable, ...]
    derived: tuple[Variable, ...] = ()
    raw: Mapping[str, Any] = field(default_factory=dict)

    @property
    def id_variable(self) -> Variable:
        found = [v for v in self.variables if v.subject_id]
        if not found:
            raise ConfigError("no variable is marked as the subject id")
        return found[0]

    @property
    def age_variable(self) -> Variable:
        found = [v for v in self.variables if v.subject_age]
        if len(found) != 1:
            raise ConfigError(f"one variable must be marked as the subject's age, not {len(found)}")
        return found[0]

    def variable(self, tag: str) -> Variable:
        return next(v for v in (*self.variables, *self.derived) if v.tag == tag)


def _list(x: Any) -> tuple[Any, ...]:
    return () if x is None else tuple(x) if isinstance(x, list) else (x,)


def variable(tag: str, d: Mapping[str, Any]) -> Variable:
    kind = d.get("type")
    if kind is not None:
        kind = "bp" if _PRESSURE.fullmatch(str(kind)) else str(kind).lower()
        if kind not in TYPES:
            raise ConfigError(f"{tag}: unknown type {d['type']!r}")
    levels = tuple(Level(str(x["name"]), tuple(map(str, _list(x.get("alternate_patterns"))))) for x in (d.get("levels") or {}).values())
    if kind in ("categorical", "binary", "ordinal", "categorical_to_numeric") and not levels:
        raise ConfigError(f"{tag}: type {kind} needs levels")
    rules = tuple(Dependency(k, str(x["name"]), str(x["condition"]), _list(x.get("table_comparisons")), _list(x.get("exclude_on_failure")), bool(x.get("exclude_all_on_failure"))) for k, x in (d.get("dependencies") or {}).items())
    bounds = {k: v for k, v in (d.get("bounds") or {}).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    return Variable(tag, str(d.get("name", tag)), str(d.get("canonical_name") or ""), kind, levels, tuple(map(str, _list(d.get("na-values")))), bounds, bool(d.get("allow_undelimited_bp")), bool(d.get("suppress_reporting")), bool(d.get("suppress_output")), bool(d.get("subject_id")), bool(d.get("subject_age")), "subject_ancestry" in d, d.get("multimodal"), d.get("linked_date"), d.get("computed_bmi"), d.get("computed_bp_ratio"), rules, d.get("code"))


def resolve(dataset: Mapping[str, Any], models: Mapping[str, Any]) -> dict[str, Any]:
    """The dataset's settings with every shared model filled in."""
    if models.get("models") is None:
        raise ConfigError("the shared models have no key 'models'")
    for key in ("tag", "globals", "variables"):
        if dataset.get(key) is None:
            raise ConfigError(f"the dataset has no key {key!r}")
    out = dict(dataset)
    for part in ("variables", "derived"):
        out[part] = {}
        for tag, d in (dataset.get(part) or {}).items():
            if (wanted := d.get("shared_model")) is not None:
                if (model := models["models"].get(wanted)) is None:
                    raise ConfigError(f"variable {tag}: the shared model {wanted!r} does not exist")
                d = merge(model, d)
            out[part][tag] = d
    return out


def build(resolved: Mapping[str, Any]) -> Dataset:
    g = resolved["globals"]
    for part in ("variables", "derived"):
        for tag in resolved[part]:
            if not re.fullmatch(r"[A-Za-z0-9_]+", str(tag)):
                raise ConfigError(f"the tag {tag!r} has characters other than letters, digits and _")
    return Dataset(str(resolved["tag"]), g.get("min_age_for_inclusion"), g.get("max_invalid_datatypes_per_subject"), g.get("consent_inclusion_file"), g.get("consent_exclusion_file"), tuple(variable(k, v) for k, v in resolved["variables"].items()), tuple(variable(k, v) for k, v in resolved["derived"].items()), resolved)


def load(dataset_path: str, models_path: str) -> Dataset:
    """Reads both files; order of variables is kept."""
    with open(dataset_path, encoding="utf-8") as f, open(models_path, encoding="utf-8") as g:
        return build(resolve(yaml.safe_load(f), yaml.safe_load(g)))


def dump(cfg: Dataset, path: str) -> None:
    """Writes tag, globals and variables; derived ones among them, names by tag with the original kept."""
    variables = {}
    for part in ("variables", "derived"):
        for tag, d in cfg.raw[part].items():
            variables[tag] = {**d, "name": tag, "original.name": d.get("name", tag)}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"tag": cfg.tag, "globals": dict(cfg.raw["globals"]), "variables": variables}, f, sort_keys=False, allow_unicode=True)


# ---- validation -------------------------------------------------------------

_STR, _BOOL, _NUM, _INT = {"type": "string"}, {"type": "boolean"}, {"type": "number"}, {"type": "integer"}
_STRINGS = {"type": "array", "items": _STR}
_DERIVED_TYPES = [t for t in TYPES if t != "categorical_to_numeric"]


def _any_case(types: list[str] | tuple[str, ...]) -> str:
    return "(?i)^(" + "|".join([*types, "blood[ _]?pressure"]) + ")$"



def _object(properties: dict[str, Any], required: tuple[str, ...] = (), closed: bool = True) -> dict[str, Any]:
    return {"type": "object", "properties": properties, "required": list(required), **({"additionalProperties": False} if closed else {})}


def _each(schema: dict[str, Any]) -> dict[str, Any]:
    return {"type": "object", "patternProperties": {"^.*$": schema}}


_LEVELS = _each(_object({"name": _STR, "alternate_patterns": _STRINGS}, ("name",), closed=False))
_COMMON = {
    "name": _STR, "canonical_name": _STR, "na-values": _STRINGS, "suppress_reporting": _BOOL, "suppress_output": _BOOL,
    "subject_id": _BOOL, "subject_age": _BOOL, "subject_ancestry": _BOOL, "multimodal": _STR, "levels": _LEVELS, "allow_undelimited_bp": _BOOL,
    "bounds": _object({"min": _NUM, "max": _NUM, "sd": _NUM}),
    "linked_date": _object({"reported_year": _STR, "reference_year": {"oneOf": [_STR, _NUM]}}, ("reported_year", "reference_year")),
    "computed_bmi": _object({"height": _STR, "weight": _STR}, ("height", "weight")),
    "computed_bp_ratio": _object({"diastolic": _STR}, ("diastolic",)),
    "dependencies": _each(_object({"name": _STR, "condition": _STR, "table_comparisons": _STRINGS, "exclude_on_failure": _STRINGS, "exclude_all_on_failure": _BOOL}, ("name", "condition"), closed=False)),
}
_TYPE = {"type": "string", "pattern": _any_case(TYPES)}
_DERIVED_TYPE = {"type": "string", "pattern": _any_case(_DERIVED_TYPES)}
_NULLABLE = {"oneOf": [_STR, {"type": "null"}]}
DATASET_SCHEMA = _object(
    {
        "tag": _STR,
        "globals": _object({"min_age_for_inclusion": _INT, "max_invalid_datatypes_per_subject": _INT, "consent_inclusion_file": _NULLABLE, "consent_exclusion_file": _NULLABLE}, ("min_age_for_inclusion",)),
        "variables": _each({"oneOf": [_object(_COMMON | {"type": _TYPE}, ("name", "type", "canonical_name")), _object(_COMMON | {"shared_model": _STR}, ("name", "shared_model", "canonical_name"))]}),
        "derived": _each(_object({"name": _STR, "type": _DERIVED_TYPE, "shared_model": _STR, "code": _STR}, ("name", "code"), closed=False)),
    },
    ("tag", "globals", "variables"),
)
MODELS_SCHEMA = _object({"models": _each(_object({"type": _TYPE, "na-values": _STRINGS, "bounds": _object({"min": _NUM, "max": _NUM}, closed=False), "suppress_reporting": _BOOL, "suppress_output": _BOOL, "allow_undelimited_bp": _BOOL, "levels": _LEVELS, "subject_ancestry": _BOOL}, ("type",)))}, ("models",))

_KINDS = {"object": Mapping, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violations(data: Any, schema: Mapping[str, Any], at: str = "") -> list[str]:
    """All places where the data break the schema, by the keywords that the schemas here use."""
    kind = schema.get("type")
    if kind in ("number", "integer"):
        if isinstance(data, bool) or not isinstance(data, (int, float)) or (kind == "integer" and data != int(data)):
            return [f"{at or '/'}: must be {kind}"]
    elif kind and not isinstance(data, _KINDS[kind]):
        return [f"{at or '/'}: must be {kind}"]
    out = []
    if "oneOf" in schema:
        tries = [violations(data, s, at) for s in schema["oneOf"]]
        fits = sum(not t for t in tries)
        if fits != 1:
            out += [f"{at or '/'}: must match exactly one schema in oneOf ({fits} match)", *[x for t in tries for x in t]]
    if "pattern" in schema and isinstance(data, str) and not re.search(schema["pattern"], data):
        out.append(f"{at or '/'}: must match pattern {schema['pattern']}")
    if isinstance(data, Mapping):
        out += [f"{at or '/'}: must have required property {k!r}" for k in schema.get("required", ()) if k not in data]
        for k, v in data.items():
            if k in schema.get("properties", {}):
                out += violations(v, schema["properties"][k], f"{at}/{k}")
            elif patterns := [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, str(k))]:
                for s in patterns:
                    out += violations(v, s, f"{at}/{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at or '/'}: must NOT have additional property {k!r}")
    if isinstance(data, list) and "items" in schema:
        for i, v in enumerate(data):
            out += violations(v, schema["items"], f"{at}/{i}")
    return out


def validate(dataset_path: str, models_path: str) -> list[str]:
    """Checks both files; one line for each that passes, an error that lists all violations otherwise."""
    said = []
    for path, schema in ((models_path, MODELS_SCHEMA), (dataset_path, DATASET_SCHEMA)):
        with open(path, encoding="utf-8") as f:
            found = violations(yaml.safe_load(f), schema)
        if found:
            raise ConfigError(f"{path}: {len(found)} violations:\n" + "\n".join(f"- {x}" for x in found))
        said.append(f"{path} passes schema validation")
    return said
