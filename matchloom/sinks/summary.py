"""Run summaries: markdown, flow charts, and the workbook report with its sidecar tabs."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame

from ..operators.output import map_columns
from ..operators.resolve import public
from . import frames
from .xlsx import BAD, GOOD, HEADER, HIGH, LOW, MIDDLE, TITLE, Workbook

STEP_HEADER = (
    "Step", "Source Pop", "Source Column", "Dest Pop", "Dest Column", "Method", "Data Tier", "Name Threshold", "Address Threshold",
    "Address Tier", "Date Filter", "Other Conditions", "Matched", "% of Total", "Leftover",
)


def _percent(n: float, total: float) -> float:
    return round(n / total * 100, 1) if total else 0.0


def describe_filters(spec: Mapping[str, Any]) -> str:
    conds = [c for c in spec.get("filter") or [] if "field" in c]
    if not conds:
        return "no filter"
    word = " or " if any(c.get("join") == "or" for c in spec["filter"]) else " and "
    show = lambda c: f"{c['field']} {c['op']}" + (f" {c.get('value', c.get('values'))}" if "value" in c or "values" in c else "")
    return word.join(map(show, conds))


def _gate(step: Mapping[str, Any]) -> str:
    if g := step.get("date_gate"):
        return f"{g['field']} < {g.get('max_age_years', 2)}yr"
    return next((f"{f['field']} < {f['value']}yr" for f in step.get("filters") or [] if f["op"] == "max_age_years"), "-")


def step_row(step: Mapping[str, Any], number: int, matched: int, total: int, so_far: int) -> list[Any]:
    m, a = step["match_fields"][0], step.get("address_support") or {}
    fuzzy = m.get("method") == "fuzzy"
    others = [f"{f['field']} {f['op']} {f.get('value', f.get('values', ''))}".strip() for f in step.get("filters") or [] if f["op"] != "max_age_years"]
    if e := step.get("exclude"):
        others.append(f"excludes {len(e.get('values') or [])} listed" + (f" and {e['file']}" if e.get("file") else ""))
    if a.get("require_street_match"):
        others.append("street must match")
    return [
        f"{number}. {step['name']}", step["source"], m["source"], step["destination"], m["destination"],
        f"fuzzy ({m.get('scorer', 'token_sort_ratio')})" if fuzzy else "exact", ", ".join(m.get("tiers") or ["raw", "clean"]),
        m.get("threshold", 80) if fuzzy else 100, a.get("threshold", "-"), ", ".join(a.get("tiers") or []) or ("all" if a else "-"), _gate(step),
        "; ".join(others) or "-", matched, f"{_percent(matched, total)}%", total - so_far,
    ]


def _rows(steps: Sequence[Mapping[str, Any]], counts: Mapping[str, int], total: int, first: int = 1) -> list[list[Any]]:
    out, so_far = [], 0
    for i, s in enumerate(steps, first):
        so_far += counts.get(s["name"], 0)
        out.append(step_row(s, i, counts.get(s["name"], 0), total, so_far))
    return out


def _table(rows: Sequence[Sequence[Any]]) -> list[str]:
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(STEP_HEADER) + " |", "|" + "---|" * len(STEP_HEADER), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]


def _label(text: Any) -> str:
    return str(text).replace('"', "'")


def flow(steps: Sequence[Mapping[str, Any]], counts: Mapping[str, int], total: int, detailed: bool = False, prefix: str = "") -> list[str]:
    """Mermaid lines of one cascade."""
    p, left = prefix, total
    out = [f'    {p}Pop["{_label(steps[0]["source"])}: {total} records"]']
    for i, s in enumerate(steps, 1):
        m, extra = s["match_fields"][0], ""
        if detailed:
            notes = [f"addr >= {t}%" for t in [(s.get("address_support") or {}).get("threshold")] if t is not None] + [g for g in [_gate(s)] if g != "-"]
            extra = "<br/>" + " | ".join(notes) if notes else ""
        out.append(f'    {p}S{i}["Step {i}: {m.get("method", "exact").capitalize()} to {_label(s["destination"])}{extra}"]')
    done = sum(counts.get(s["name"], 0) for s in steps)
    out += [f"    {p}M[Matched: {done}]", f"    {p}U[Unmatched: {total - done}]", f"    {p}Pop --> {p}S1"]
    for i, s in enumerate(steps, 1):
        n = counts.get(s["name"], 0)
        left -= n
        if n:
            out.append(f"    {p}S{i} -->|{n} matched| {p}M")
        if i < len(steps):
            out.append(f"    {p}S{i} -.->|{left} remaining| {p}S{i + 1}")
        elif left:
            out.append(f"    {p}S{i} -->|{left} unmatched| {p}U")
    return out


def mermaid(recipe: Mapping[str, Any], stats: Mapping[str, Any], detailed: bool = False) -> str:
    if "phases" not in recipe:
        return "\n".join(["flowchart TD", *flow(recipe["steps"], stats["step_counts"], stats["total_source"], detailed)])
    out = ["flowchart TD"]
    by_name = {p["name"]: p for p in stats.get("phases", [])}
    last = None
    for i, p in enumerate(recipe["phases"], 1):
        s = by_name.get(p.get("name", f"Phase {i}"))
        if not s or not p.get("steps"):
            continue
        out.append(f'    subgraph P{i}["{_label(s["name"])}"]')
        out += ["    " + x for x in flow(p["steps"], s["step_counts"], s["input_count"], detailed, f"P{i}")]
        out.append("    end")
        if last:
            out.append(f"    P{last}M ==> P{i}Pop")
        last = i
    return "\n".join(out)


def echo(recipe: Mapping[str, Any]) -> str:
    """The recipe as YAML that reads back equal."""
    return yaml.safe_dump(json.loads(json.dumps(recipe, default=str)), sort_keys=False, allow_unicode=True)


def read_echo(text: str) -> dict[str, Any]:
    return yaml.safe_load(text)


def markdown(recipe: Mapping[str, Any], stats: Mapping[str, Any], seconds: Mapping[str, float] | None = None, chart: str = "default", recipe_file: str | None = None) -> str:
    from ..plans.recipe import populations_of, steps_of

    total, matched = stats["total_source"], stats["matched_count"]
    out = [f"# {recipe.get('name', 'Recipe')} - Run Summary"]
    out += [f"**Recipe file:** `{recipe_file}`  "] * bool(recipe_file) + [f"*{recipe.get('description')}*"] * bool(recipe.get("description"))
    out += ["", "**Populations:**"]
    sources, targets = {s["source"] for s in steps_of(recipe)}, {s["destination"] for s in steps_of(recipe)}
    for name, p in populations_of(recipe).items():
        if p["source"] == "_previous_matched":
            continue
        file = (recipe["sources"].get(p["source"]) or {}).get("file")
        at, what = f" from {file}" if file else "", f"({describe_filters(p)})"
        if p.get("action") == "exclude":
            out.append(f"- **{name}:** excluded {what}")
        else:
            out.append(f"- **{name}:** " + (f"{total} records{at} {what} - *matching target*" if name in sources else f"{at.strip()} {what}" + " - *destination*" * (name in targets)))
    out += ["", f"**Matched:** {matched} of {total} ({_percent(matched, total)}%)  ", f"**Unmatched:** {stats['unmatched_count']}  "]
    if seconds:
        out.append("**Timing:** " + " | ".join(f"{k} {v:.2f}s" for k, v in seconds.items()) + "  ")
    out.append("")
    if stats.get("exclusions"):
        out += ["**Exclusions:**", *(f"- {name}: {len(e['values'])} listed on {e['field']}" for name, e in stats["exclusions"].items()), ""]
    out += ["**Matching steps (in priority order):**", ""]
    if "phases" in recipe:
        n, by_name = 1, {p["name"]: p for p in stats.get("phases", [])}
        for i, p in enumerate(recipe["phases"], 1):
            s = by_name.get(p.get("name", f"Phase {i}"), {"input_count": 0, "matched_count": 0, "step_counts": {}})
            out += [f"**{p.get('name', f'Phase {i}')}** (Input: {s['input_count']} | Matched: {s['matched_count']})", "", *_table(_rows(p.get("steps") or [], s["step_counts"], s["input_count"], n)), ""]
            n += len(p.get("steps") or [])
        out.append("Each phase's matches are the next one's input. Records that match early but not later keep nulls for what they missed.")
    else:
        out += [*_table(_rows(recipe["steps"], stats["step_counts"], total)), "", "A record that a step doesn't match, or whose match fails a threshold, is left to the other steps; it is unmatched if all fail."]
    if chart != "disabled":
        out += ["", "**Matching flow:**", "", "```mermaid", mermaid(recipe, stats, chart == "detailed"), "```"]
    return "\n".join([*out, "", "## Recipe", "", "```yaml", echo(recipe).rstrip(), "```", ""])


# ---- workbook ----------------------------------------------------------------------------------------------------------
SIDECARS = {"Exclusions": ("exclusions",), "Stopwords": ("normalization", "stopwords"), "Aliases": ("normalization", "aliases"), "Groups": ("output", "groups", "file")}


def sidecar_rows(recipe: Mapping[str, Any], keys: Sequence[str], base_dir: str = ".") -> Iterator[list[Any]] | None:
    """The lines of a sidecar file as they stand, or None if there is no such file."""
    value: Any = recipe
    for k in keys:
        value = value.get(k) if isinstance(value, Mapping) else None
    if isinstance(value, Mapping):
        value = value.get("file")
    if not isinstance(value, str):
        return None
    path = next((p for p in (Path(value), Path(base_dir, value)) if p.is_file()), None)
    if path is None:
        return None
    return csv.reader(_lines(path)) if path.suffix.lower() == ".csv" else ([x] for x in _lines(path))


def _lines(path: Path) -> Iterator[str]:
    with path.open(encoding="utf-8-sig") as f:
        for line in f:
            yield from line.splitlines()


def _summary_rows(recipe: Mapping[str, Any], stats: Mapping[str, Any], seconds: Mapping[str, float] | None, recipe_file: str | None) -> Iterator[list[Any]]:
    yield [(f"{recipe.get('name', 'Recipe')} - Run Summary", TITLE)]
    yield ["Recipe file", recipe_file or ""]
    yield ["Description", recipe.get("description", "")]
    total = stats["total_source"]
    yield ["Source records", total]
    yield ["Matched", stats["matched_count"], f"{_percent(stats['matched_count'], total)}%"]
    yield ["Unmatched", stats["unmatched_count"], f"{_percent(stats['unmatched_count'], total)}%"]
    for k, v in (seconds or {}).items():
        yield [f"Seconds: {k}", round(v, 2)]
    for name, e in (stats.get("exclusions") or {}).items():
        yield ["Excluded", name, f"{len(e['values'])} listed on {e['field']}"]
    if "phases" in recipe:
        n, by_name = 1, {p["name"]: p for p in stats.get("phases", [])}
        for i, p in enumerate(recipe["phases"], 1):
            name = p.get("name", f"Phase {i}")
            s = by_name.get(name, {"input_count": 0, "matched_count": 0, "step_counts": {}})
            yield []
            yield [(name, TITLE), f"Input: {s['input_count']}", f"Matched: {s['matched_count']}"]
            yield [(h, HEADER) for h in STEP_HEADER]
            yield from _rows(p.get("steps") or [], s["step_counts"], s["input_count"], n)
            n += len(p.get("steps") or [])
    else:
        yield []
        yield [(h, HEADER) for h in STEP_HEADER]
        yield from _rows(recipe["steps"], stats["step_counts"], total)


def band(score: Any) -> int | None:
    """The colour of a score of 0 to 100."""
    if not isinstance(score, int | float):
        return None
    return HIGH if score >= 80 else MIDDLE if score >= 60 else LOW


def report(
    path: str | Path, matched: DataFrame, unmatched: DataFrame | None, recipe: Mapping[str, Any], stats: Mapping[str, Any], output: Mapping[str, Any] | None = None,
    seconds: Mapping[str, float] | None = None, recipe_file: str | None = None, base_dir: str = ".", merged: DataFrame | None = None,
) -> None:
    """Summary, Matched (or Merged), Analysis, Recipe and a tab for each sidecar file. Tasks write the rows, sidecar files stream."""
    output = (recipe.get("output") or {}) if output is None else output
    verdict = {"higher": BAD, "lower": GOOD}.get  # higher is worse
    names = [c["output"] for c in output.get("compare_columns") or []]
    with Workbook(path) as book:
        book.sheet("Summary", _summary_rows(recipe, stats, seconds, recipe_file), widths=[32, 20, 20, 20, 20, 24, 18], header=0)
        shown = merged if merged is not None else map_columns(public(matched), output, "matched", coalesce=True)
        heads = {(e.get("header") or e.get("field")): e.get("field") for e in (output.get("columns") or {}).get("matched") or []}
        marks = {i: verdict for i, c in enumerate(shown.columns) if heads.get(c, c) in names}
        marks |= {i: band for i, c in enumerate(shown.columns) if heads.get(c, c) in ("name_score", "addr_score")}
        frames.table(book, "Merged" if merged is not None else "Matched", shown, [20] * len(shown.columns), marks)
        if unmatched is not None:
            rest = frames.unmatched_export(public(unmatched), output)
            frames.table(book, "Analysis", rest, [20] * len(rest.columns))
        book.sheet("Recipe", ([x] for x in echo(recipe).splitlines()), widths=[100], header=0)
        for tab, keys in SIDECARS.items():
            if (rows := sidecar_rows(recipe, keys, base_dir)) is not None:
                book.sheet(tab, rows, header=0)
