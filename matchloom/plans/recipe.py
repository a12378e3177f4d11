"""Recipes: reading, defaults, and validation against a grammar and against the data."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame

from ..functions.address import Patterns
from ..operators.filters import FILTER_OPS, step_filters
from ..operators.output import FLAG, GROUP, UNMATCHED, computed_names
from ..sinks.frames import formats


class RecipeError(ValueError):
    """A recipe that can't be run."""


# ---- grammar -----------------------------------------------------------------------------------------------------------
# A rule is a type, a tuple of allowed values, [rule] for a list, {key: rule} for an object ("!" after a key: required;
# "*": any key), or any(...) of several.
STR, INT, NUM, BOOL, ANY = str, int, (int, float), bool, object


class OneOf(tuple):
    """Any of these rules."""


def one_of(*rules: Any) -> OneOf:
    return OneOf(rules)


class Enum(tuple):
    """One of these values."""


_CONDITION = {"field": STR, "op": Enum(FILTER_OPS), "value": ANY, "values": [ANY], "ignore_case": BOOL, "join": Enum(("and", "or"))}
_STEP_FILTER = {"field!": STR, "op!": Enum((*FILTER_OPS, "max_age_years")), "value": ANY, "values": [ANY], "ignore_case": BOOL, "applies_to": Enum(("source", "destination", "both"))}
_SOURCE = {
    "file": STR, "loader": Enum(("file", "sql", "http")), "columns": [STR], "type": STR, "driver": STR, "connection": {"*": ANY}, "query": STR, "url": STR,
    "url_from": {"endpoint!": STR, "json_path!": STR, "headers": {"*": ANY}}, "format": STR, "zip_entry": STR, "headers": {"*": ANY}, "verify": ANY,
    "timeout": NUM, "cache_ttl": one_of(STR, INT, BOOL), "cache_format": Enum(("parquet", "csv")),
}
_POPULATION = {"source!": STR, "record_key": STR, "filter": [_CONDITION], "action": Enum(("exclude",)), "invalid_fields": [STR]}
_STEP = {
    "name": STR, "description": STR, "source": STR, "destination": STR,
    "match_fields": [{"source!": STR, "destination!": STR, "method": Enum(("exact", "fuzzy")), "tiers": [Enum(("raw", "clean", "normalized"))], "threshold": NUM, "scorer": STR}],
    "address_support": {
        "source!": [STR], "destination!": [STR], "parser": Enum(("auto", "default", "libpostal")), "tiers": [Enum(("raw", "clean", "normalized"))], "threshold": NUM,
        "weights": {"street_name": NUM}, "require_street_match": BOOL,
    },
    "date_gate": {"field!": STR, "max_age_years": NUM, "applies_to": Enum(("source", "destination", "both"))},
    "filters": [_STEP_FILTER], "exclude": {"field": STR, "values": [ANY], "file": STR}, "inherit": [{"source!": STR, "as!": STR}],
}
_COLUMN = {"field": STR, "fields": [STR], "header": STR, "*unknown": ANY}
_OUTPUT = {
    "format": one_of(Enum(("xlsx", "csv", "parquet")), [Enum(("xlsx", "csv", "parquet"))]), "path": STR, "mode": Enum(("standard", "enriched")), "enrich_source": STR, "enrich_key": STR,
    "match_mode": Enum(("best_match", "all_matches")), "summary": one_of(Enum(("none", "md", "xlsx")), [Enum(("none", "md", "xlsx"))]), "tabs": ANY,
    "columns": {"matched": [_COLUMN], "analysis": [_COLUMN]}, "tie_breaker": {"column!": STR, "strip_prefix": STR, "order": Enum(("asc", "desc"))},
    "final_rollup": [{"steps": [STR], "group_key!": STR, "group_key_tier": Enum(("raw", "clean", "normalized")), "target!": STR, "strip_prefix": STR, "order": Enum(("asc", "desc")), "write_to": STR}],
    "decision_record": {"candidates": [STR], "select": STR, "write_to": STR, "strip_prefix": STR}, "compare_columns": [{"left!": STR, "right!": STR, "output!": STR, "strip_prefix": STR}],
    "groups": {"file": STR, "mode": STR}, "matched_unmatched": one_of(Enum(("separate", "merged")), [Enum(("separate", "merged"))]), "emit_unmatched": BOOL,
}
_NORMALIZATION = {"stopwords": ANY, "aliases": ANY, "unicode": {"ranges": STR, "mode": STR}, "address_patterns": STR}
_RECIPE = {
    "name": STR, "description": STR, "sources": {"*": _SOURCE}, "populations": {"*": _POPULATION}, "steps": [_STEP], "step_defaults": {"*": ANY},
    "phases": [{"name": STR, "description": STR, "populations": {"*": _POPULATION}, "steps": [_STEP], "step_defaults": {"*": ANY}, "output": _OUTPUT}],
    "exclusions": one_of(STR, {"file!": STR, "id_column": STR}), "normalization": _NORMALIZATION, "output": _OUTPUT,
}


def _check(value: Any, rule: Any, at: str, errors: list[str], warnings: list[str]) -> None:
    if rule is ANY:
        return
    if isinstance(rule, OneOf):
        tried = []
        for r in rule:
            e: list[str] = []
            w: list[str] = []
            _check(value, r, at, e, w)
            if not e:
                warnings += w
                return
            tried += e
        errors.append(tried[-1 if isinstance(value, list | Mapping) else 0])
    elif isinstance(rule, Enum):
        if value not in rule:
            errors.append(f"{at}: {value!r} is not one of {', '.join(map(str, rule))}")
    elif isinstance(rule, list):
        if not isinstance(value, list):
            errors.append(f"{at}: {value!r} is not a list")
            return
        for i, v in enumerate(value):
            _check(v, rule[0], f"{at}[{i}]", errors, warnings)
    elif isinstance(rule, dict):
        if not isinstance(value, Mapping):
            errors.append(f"{at}: {value!r} is not an object")
            return
        known = {k.rstrip("!"): r for k, r in rule.items()}
        errors.extend(f"{at}: {k[:-1]!r} is required" for k in rule if k.endswith("!") and k[:-1] not in value)
        for k, v in value.items():
            if k in known:
                _check(v, known[k], f"{at}.{k}", errors, warnings)
            elif "*" in known:
                _check(v, known["*"], f"{at}.{k}", errors, warnings)
            else:
                warnings.append(f"{at}: unknown key {k!r}")
    elif not isinstance(value, rule) or isinstance(value, bool) and rule in (INT, NUM):
        errors.append(f"{at}: {value!r} has the wrong type")


# ---- reading -----------------------------------------------------------------------------------------------------------
def merge(base: Any, over: Any) -> Any:
    """Objects merge key by key; anything else is replaced."""
    if isinstance(base, Mapping) and isinstance(over, Mapping):
        return {k: merge(base[k], over[k]) if k in base and k in over else copy.deepcopy(over.get(k, base.get(k))) for k in [*base, *(k for k in over if k not in base)]}
    return copy.deepcopy(over)


def with_defaults(recipe: Mapping[str, Any]) -> dict[str, Any]:
    """step_defaults merged into the steps; a phase's own go over the recipe's."""
    out = copy.deepcopy(dict(recipe))
    top = out.pop("step_defaults", None) or {}
    if top and "steps" in out:
        out["steps"] = [merge(top, s) for s in out["steps"]]
    for p in out.get("phases") or []:
        own = merge(top, p.pop("step_defaults", None) or {})
        if own and p.get("steps"):
            p["steps"] = [merge(own, s) for s in p["steps"]]
    return out


def loads(text: str, kind: str = "yaml") -> dict[str, Any]:
    try:
        data = json.loads(text) if kind == "json" else yaml.safe_load(text)
    except json.JSONDecodeError as e:
        raise RecipeError(f"invalid JSON at line {e.lineno}, column {e.colno}: {e.msg}") from e
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        where = f" at line {mark.line + 1}, column {mark.column + 1}" if mark else ""
        raise RecipeError(f"invalid YAML{where}: {getattr(e, 'problem', e)}") from e
    if not isinstance(data, dict):
        raise RecipeError("a recipe is an object")
    return with_defaults(data)


def load(path: str | Path) -> dict[str, Any]:
    p = Path(path)
    return loads(p.read_text(encoding="utf-8"), "json" if p.suffix.lower() == ".json" else "yaml")


# ---- validation of structure -------------------------------------------------------------------------------------------
#: Columns that the engine makes itself.
METADATA = ("match_tier", "name_score", "addr_score", "addr_street_match", "addr_comparison", "addr_tier", "match_step", "reason_code", "rejection_step", "best_rejected_score")
COMPUTED_FEATURES = ("decision_record", "compare_columns", "groups", "final_rollup", "matched_unmatched")


def steps_of(recipe: Mapping[str, Any]) -> list[dict[str, Any]]:
    if "phases" in recipe:
        return [s for p in recipe["phases"] or [] for s in p.get("steps") or []]
    return list(recipe.get("steps") or [])


def populations_of(recipe: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    out = dict(recipe.get("populations") or {})
    for p in recipe.get("phases") or []:
        out |= p.get("populations") or {}
    return out


def outputs_of(recipe: Mapping[str, Any]) -> list[tuple[str, dict[str, Any]]]:
    named = [("output", recipe["output"])] if "output" in recipe else []
    return named + [(p.get("name", f"phase {i}"), p["output"]) for i, p in enumerate(recipe.get("phases") or [], 1) if "output" in p]


def rollup_names(output: Mapping[str, Any]) -> list[tuple[str, str]]:
    return [(to := b.get("write_to", "rolled_supplier_id"), f"{to}_changed") for b in output.get("final_rollup") or []]


def derived_columns(recipe: Mapping[str, Any], rollups: bool = True) -> set[str]:
    """Every column that isn't in the data but in results."""
    out = {*METADATA, *(i["as"] for s in steps_of(recipe) for i in s.get("inherit") or [] if "as" in i)}
    for _, o in outputs_of(recipe):
        out |= {n for pair in rollup_names(o) for n in pair} if rollups else set()
        out |= set(computed_names(o))
    return out


def summary_modes(output: Mapping[str, Any]) -> list[str]:
    s = output.get("summary")
    return [] if s in (None, "none") else [s] if isinstance(s, str) else [x for x in s if x != "none"]


def _placement(recipe: Mapping[str, Any]) -> Iterable[str]:
    many = "phases" in recipe
    needed = ["name", "sources", "phases"] if many else ["name", "sources", "populations", "steps", "output"]
    if missing := [k for k in needed if k not in recipe]:
        yield f"the recipe lacks {', '.join(missing)}"
    if many and "output" in recipe:
        yield "a recipe with phases has its output in the phases, not at the top"
    if many and not missing and not any("output" in p for p in recipe["phases"]):
        yield "no phase has an output"
    if not many and "output" in recipe and "format" not in recipe["output"]:
        yield "output: format is missing"
    for name, s in (recipe.get("sources") or {}).items():
        if isinstance(s, Mapping) and "file" not in s and "loader" not in s:
            yield f"source {name!r} has neither file nor loader"
    for label, o in outputs_of(recipe):
        if o.get("mode") == "enriched":
            if not o.get("enrich_source"):
                yield f"{label}: mode enriched needs enrich_source"
            elif o["enrich_source"] not in (recipe.get("sources") or {}):
                yield f"{label}: enrich_source {o['enrich_source']!r} is not a source"
            if not o.get("enrich_key"):
                yield f"{label}: mode enriched needs enrich_key"
        if many:
            yield from (f"{label}: {k} works in recipes without phases only" for k in COMPUTED_FEATURES if o.get(k))


def _steps(recipe: Mapping[str, Any]) -> Iterable[str]:
    seen: dict[str, int] = {}
    pops = populations_of(recipe)
    for i, s in enumerate(steps_of(recipe)):
        yield from (f"step {i} ({s.get('name', '?')!r}) lacks {k!r}" for k in ("name", "source", "destination", "match_fields") if not s.get(k))
        name = s.get("name")
        if name == UNMATCHED:
            yield f"the step name {UNMATCHED!r} is reserved for unmatched rows of the merged view"
        if name in seen:
            yield f"steps {seen[name]} and {i} are both named {name!r}"
        seen.setdefault(name, i)
        if (pops.get(s.get("source")) or {}).get("action") == "exclude":
            yield f"population {s['source']!r} is excluded but is a step's source"


def _names(recipe: Mapping[str, Any]) -> Iterable[str]:
    """Collisions between columns that are made, and made columns that are read as input."""
    out = recipe.get("output") or {}
    steps = {s.get("name") for s in steps_of(recipe)}
    taken: dict[str, str] = {FLAG: "the merged view's flag", UNMATCHED: "the merged view's step name"}
    taken |= {c: "a column of the engine" for c in METADATA}
    inherited = {i["as"]: "an inherited column" for s in steps_of(recipe) for i in s.get("inherit") or [] if "as" in i}
    taken |= inherited
    claimed: dict[str, str] = {}
    for i, (b, names) in enumerate(zip(out.get("final_rollup") or [], rollup_names(out), strict=True)):
        yield from (f"output.final_rollup[{i}]: there is no step {s!r}" for s in b.get("steps") or [] if s not in steps)
        yield from (f"output.final_rollup[{i}]: column {n!r} is made by {claimed[n]} too" for n in names if n in claimed)
        claimed |= dict.fromkeys(names, f"output.final_rollup[{i}]")
    taken |= claimed
    made: dict[str, str] = {}
    decision, groups = out.get("decision_record"), out.get("groups")
    parts = []
    if decision and decision.get("write_to"):
        parts.append(("output.decision_record", [decision["write_to"], f"{decision['write_to']}_src"]))
    if groups:
        parts.append(("output.groups", [GROUP]))
    parts += [(f"output.compare_columns[{i}]", [c["output"]]) for i, c in enumerate(out.get("compare_columns") or []) if c.get("output")]
    for label, names in parts:
        for n in names:
            if n in taken or n in made:
                yield f"{label}: {n!r} collides with {taken.get(n) or made[n]}"
            made[n] = f"a column of {label}"
    reads = [(f"output.decision_record: candidate {c!r}", c) for c in (decision or {}).get("candidates") or []]
    reads += [(f"output.compare_columns[{i}]: {side} {c[side]!r}", c[side]) for i, c in enumerate(out.get("compare_columns") or []) for side in ("left", "right") if side in c]
    yield from (f"{label} is {made[n]}; only columns of sources and steps can be read" for label, n in reads if n in made)
    if decision is not None:
        if not decision.get("write_to"):
            yield "output.decision_record: write_to is required"
        if len(decision.get("candidates") or []) < 2:
            yield "output.decision_record: candidates needs two at least"
        if decision.get("select", "first") not in ("first", "min", "max"):
            yield f"output.decision_record: select {decision['select']!r} is not one of first, min, max"
    if groups is not None:
        if not groups.get("file"):
            yield "output.groups: file is required"
        if groups.get("mode", "all_match") not in ("all_match", "first_match"):
            yield f"output.groups: mode {groups['mode']!r} is not one of all_match, first_match"
    for label, o in outputs_of(recipe):
        for key, entries in (o.get("columns") or {}).items():
            for i, e in enumerate(x for x in entries or [] if isinstance(x, Mapping)):
                if FLAG in (e.get("field"), e.get("header"), *(e.get("fields") or [])):
                    yield f"{label}.columns.{key}[{i}]: {FLAG} is reserved"
                if key == "analysis" and e.get("field") in computed_names(o):
                    yield f"{label}.columns.analysis[{i}]: {e['field']!r} is computed for matched rows only"


def _advice(recipe: Mapping[str, Any]) -> Iterable[str]:
    for i, p in enumerate(recipe.get("phases") or [], 1):
        if "output" not in p:
            yield f"{p.get('name', f'phase {i}')} has no output; its results aren't written"
    for label, o in outputs_of(recipe):
        if "emit_unmatched" in o and "matched_unmatched" in o:
            yield f"{label}: emit_unmatched is deprecated and ignored beside matched_unmatched"
        if "tabs" in o:
            yield f"{label}: tabs is deprecated and ignored"
        if o.get("format") == "xlsx" and "summary" not in o:
            yield f"{label}: format xlsx without summary; add summary: [md, xlsx] or summary: none"
        if o.get("emit_unmatched") and "matched_unmatched" not in o and o.get("format") == "xlsx" and "xlsx" in summary_modes(o):
            yield f"{label}: emit_unmatched has no effect on an xlsx report, which has unmatched rows anyway"
    pops, steps = populations_of(recipe), steps_of(recipe)
    for name in dict.fromkeys(s.get("source") for s in steps):
        if name in pops and "record_key" not in pops[name]:
            yield f"population {name!r} has no record_key; rows of one name may be taken for one record"
    for name in dict.fromkeys(s.get("destination") for s in steps):
        if (pops.get(name) or {}).get("action") == "exclude":
            yield f"population {name!r} is excluded but is a step's destination"


def validate(recipe: Mapping[str, Any]) -> list[str]:
    """Warnings; raises RecipeError with all errors at once."""
    errors: list[str] = []
    warnings: list[str] = []
    _check(recipe, _RECIPE, "$", errors, warnings)
    if not errors:
        for rules in (_placement, _steps, _names):
            errors += rules(recipe)
        warnings += _advice(recipe)
    if errors:
        raise RecipeError(errors[0] if len(errors) == 1 else "the recipe has errors:\n  - " + "\n  - ".join(errors))
    return warnings


# ---- validation against the data ---------------------------------------------------------------------------------------
def validate_fields(recipe: Mapping[str, Any], sources: Mapping[str, DataFrame], groups: Sequence[Mapping[str, Any]] = ()) -> tuple[list[str], list[str]]:
    """Errors and warnings about names that the data lack. Reads schemas only. Names that earlier phases provide are unknown
    here and pass."""
    errors: list[str] = []
    warnings: list[str] = []
    pops = populations_of(recipe)

    def columns(name: str) -> set[str] | None:
        source = (pops.get(name) or {}).get("source", name)
        return set(sources[source].columns) if source in sources else None

    def need(field: str | None, have: set[str] | None, where: str, to: list[str]) -> None:
        if field and have is not None and field not in have:
            to.append(f"{where}: there is no column {field!r}; there are {', '.join(sorted(have))}")

    for name, p in pops.items():
        for c in p.get("filter") or []:
            need(c.get("field"), columns(name), f"population {name!r} filter", warnings)
    for i, s in enumerate(steps_of(recipe), 1):
        at, src, dst = f"step {i} {s.get('name', '?')!r}", columns(s["source"]), columns(s["destination"])
        for m in s["match_fields"]:
            need(m["source"], src, f"{at} match_fields.source", errors)
            need(m["destination"], dst, f"{at} match_fields.destination", errors)
        a = s.get("address_support") or {}
        for side, have in (("source", src), ("destination", dst)):
            for f in a.get(side) or []:
                need(f, have, f"{at} address_support.{side}", warnings)
        for f in step_filters(s):
            for side, have in (("destination", dst), ("source", src)):
                if f.get("applies_to", "destination") in (side, "both"):
                    need(f["field"], have, f"{at} filters ({side})", warnings)
        for x in s.get("inherit") or []:
            if dst is not None and src is not None:
                need(x["source"], dst | src, f"{at} inherit", errors)
    data = {c for df in sources.values() for c in df.columns}
    derived = derived_columns(recipe)
    either = data | derived | {c + "_dst" for c in data} | {f"{c}_dst{n}" for c in data for n in range(2, 6)}
    plain = either - {n for _, o in outputs_of(recipe) for n in computed_names(o)}
    for label, o in outputs_of(recipe):
        for key, entries in (o.get("columns") or {}).items():
            for i, e in enumerate(entries or []):
                if ("field" in e) == ("fields" in e):
                    errors.append(f"{label}.columns.{key}[{i}]: give field or fields, one of them")
                elif "field" in e:
                    need(e["field"], either, f"{label}.columns.{key}[{i}]", errors)
                else:
                    for f in e["fields"]:
                        need(f, either, f"{label}.columns.{key}[{i}] variant", warnings)
        for name in computed_names(o):
            if name in data:
                errors.append(f"{label}: the computed column {name!r} is a column of the data")
        for c in (o.get("decision_record") or {}).get("candidates") or []:
            need(c, plain, f"{label}.decision_record candidate", errors)
        for i, c in enumerate(o.get("compare_columns") or []):
            for side in ("left", "right"):
                need(c[side], plain, f"{label}.compare_columns[{i}].{side}", errors)
        for i, b in enumerate(o.get("final_rollup") or []):
            for k in ("group_key", "target"):
                need(b[k], plain, f"{label}.final_rollup[{i}].{k}", errors)
            if (to := b.get("write_to", "rolled_supplier_id")) in plain - {n for pair in rollup_names(o) for n in pair} or to == b["target"]:
                errors.append(f"{label}.final_rollup[{i}]: write_to {to!r} is a column already")
    for g in groups:
        for c in g.get("match_columns") or []:
            need(c, data, f"group {g.get('group_name')!r} match_columns", errors)
    return errors, warnings


def missing_filter_fields(recipe: Mapping[str, Any], sources: Mapping[str, DataFrame]) -> list[str]:
    """Population filters on columns that their source lacks: such a run can't begin."""
    return [
        f"population {name!r} filter: source {p['source']!r} has no column {c['field']!r}"
        for name, p in populations_of(recipe).items() if p["source"] in sources
        for c in p.get("filter") or [] if "field" in c and c["field"] not in sources[p["source"]].columns
    ]


# ---- sidecars ----------------------------------------------------------------------------------------------------------
_LOOKS_AROUND = re.compile(r"\(\?(?:=|!|<=|<!)|\\[1-9]")
GROUP_KEYS = {"group_name", "regex", "exclude_regex", "values", "match_columns"}


def regex_fault(pattern: str) -> str | None:
    """Patterns run on a linear-time dialect: no look-around, no back-references."""
    if _LOOKS_AROUND.search(pattern):
        return "look-around and back-references aren't supported"
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}|\\[pP]\w", "x", pattern))
    except re.error as e:
        return str(e)
    return None


def sidecar(ref: str, base_dir: str = ".") -> Path | None:
    return next((p for p in (Path(ref), Path(base_dir, ref)) if p.exists()), None)


def read_groups(output: Mapping[str, Any], base_dir: str = ".") -> tuple[list[dict[str, Any]], list[str], list[str]]:
    """Group definitions, warnings and errors of the output's groups file."""
    ref = (output.get("groups") or {}).get("file")
    if not ref:
        return [], [], []
    if (path := sidecar(ref, base_dir)) is None:
        return [], [], [f"output.groups: there is no file {ref!r}, here or in {base_dir!r}"]
    try:
        raw = json.loads(path.read_text(encoding="utf-8-sig"))
    except json.JSONDecodeError as e:
        return [], [], [f"output.groups: {path} is not JSON (line {e.lineno}, column {e.colno}): {e.msg}"]
    groups = raw.get("groups") if isinstance(raw, dict) else None
    if not isinstance(groups, list) or not groups:
        return [], [], [f"output.groups: {path} has no list of groups"]
    errors, extra, seen = [], [], {}
    for i, g in enumerate(groups):
        if not isinstance(g, dict):
            errors.append(f"output.groups: entry {i} is not an object")
            continue
        name = g.get("group_name")
        label = repr(name) if name else f"entry {i}"
        if not name:
            errors.append(f"output.groups: entry {i} has no group_name")
        elif name in seen:
            errors.append(f"output.groups: entries {seen[name]} and {i} are both named {name!r}")
        seen.setdefault(name, i)
        for k in ("regex", "exclude_regex"):
            if g.get(k) is not None and (fault := regex_fault(g[k])):
                errors.append(f"output.groups: {label} {k} {g[k]!r}: {fault}")
        if not g.get("regex") and not g.get("values"):
            errors.append(f"output.groups: {label} has neither regex nor values")
        if not isinstance(g.get("match_columns"), list) or not g["match_columns"]:
            errors.append(f"output.groups: {label} has no match_columns")
        extra += [f"{label}.{k}" for k in g if k not in GROUP_KEYS]
    warnings = [f"output.groups: unknown keys are ignored: {', '.join(extra)}"] if extra and not errors else []
    return groups, warnings, errors


def _json(ref: Any, base_dir: str) -> Any:
    if not isinstance(ref, str):
        return ref
    path = sidecar(ref, base_dir)
    return json.loads(path.read_text(encoding="utf-8-sig")) if path else None


def normalization(cfg: Mapping[str, Any] | None, base_dir: str = ".") -> tuple[dict[str, Any], list[str]]:
    """Aliases, stop words and address words. A flat alias map is for addresses; a flat stop word list for both."""
    cfg = cfg or {}
    aliases, stop, warnings = _json(cfg.get("aliases"), base_dir) or {}, _json(cfg.get("stopwords"), base_dir) or [], []
    if aliases and not any(isinstance(v, Mapping) for v in aliases.values()):
        warnings.append("aliases without name and address sections are used for addresses only")
        aliases = {"address": aliases}
    if isinstance(stop, Mapping):
        rest = [w for k, v in stop.items() if k not in ("name", "address") for w in v]
        stop = {k: [*stop.get(k, []), *rest] for k in ("name", "address")}
    else:
        stop = {"name": list(stop), "address": list(stop)}
    out = {"name_aliases": aliases.get("name") or {}, "addr_aliases": aliases.get("address") or {}, "name_stopwords": stop["name"], "addr_stopwords": stop["address"]}
    if ref := cfg.get("address_patterns"):
        if (path := sidecar(ref, base_dir)) is None:
            raise RecipeError(f"normalization.address_patterns: there is no file {ref!r}, here or in {base_dir!r}")
        out["addr_patterns"] = Patterns.load(path)
    if cfg.get("unicode"):
        warnings.append("normalization.unicode has no effect on matching; the profiler counts scripts")
    return out, warnings


def route_exclusions(recipe: Mapping[str, Any], listed: Mapping[str, Sequence[str]]) -> dict[str, Any]:
    """The global exclusions become each step's own."""
    out = copy.deepcopy(dict(recipe))
    known = {s.get("name") for s in steps_of(out)}
    if unknown := [s for s in listed if s not in known]:
        raise RecipeError(f"the exclusions name steps that don't exist: {', '.join(unknown)}")
    for s in steps_of(out):
        if ids := listed.get(s.get("name")):
            e = s.setdefault("exclude", {})
            e["values"] = [*(e.get("values") or []), *ids]
    return out


__all__ = ["RecipeError", "formats", "load", "loads", "validate", "validate_fields"]
