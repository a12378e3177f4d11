"""The filter language, populations, date gates and exclusions."""

from __future__ import annotations

import csv
import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column


def literal(value: Any) -> str:
    return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _text_op(test: Callable[[Column, Any], Column], key: str = "value") -> Callable[[Column, Mapping[str, Any]], Column]:
    def build(c: Column, cond: Mapping[str, Any]) -> Column:
        value = cond.get(key)
        value = [literal(v) for v in value or ()] if key == "values" else literal(value)
        c = c.cast("string")
        if cond.get("ignore_case"):
            c = F.lower(c)
            value = [v.lower() for v in value] if key == "values" else value.lower()
        return test(c, value)

    return build


#: Operators by name. Comparisons with null are unknown, so neither a condition nor its negation keeps the row.
FILTER_OPS: dict[str, Callable[[Column, Mapping[str, Any]], Column]] = {
    "eq": _text_op(lambda c, v: c == v),
    "neq": _text_op(lambda c, v: c != v),
    "starts_with": _text_op(lambda c, v: c.startswith(v)),
    "not_starts_with": _text_op(lambda c, v: ~c.startswith(v)),
    "contains": _text_op(lambda c, v: c.contains(v)),
    "contains_any": _text_op(lambda c, v: reduce(lambda x, y: x | y, [c.contains(x) for x in v], F.lit(False)), "values"),
    "is_null": lambda c, _: c.isNull(),
    "is_not_null": lambda c, _: c.isNotNull(),
}


def condition(conds: Sequence[Mapping[str, Any]], mode: str = "and") -> Column:
    """All conditions, or any where the list has a ``join: or`` (in a condition or by itself). No conditions: true."""
    mode = next((c["join"] for c in conds if "join" in c), mode)
    built = []
    for c in conds:
        if "field" not in c:
            continue
        if c.get("op") not in FILTER_OPS:
            raise ValueError(f"unknown filter operator {c.get('op')!r}; known: {', '.join(FILTER_OPS)}")
        built.append(FILTER_OPS[c["op"]](column(c["field"]), c))
    if not built:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if mode == "or" else (lambda a, b: a & b), built)


def population(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    return df.where(condition(spec.get("filter") or []))


def populations(specs: Mapping[str, Mapping[str, Any]], sources: Mapping[str, DataFrame], previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """Each population as a lazy frame. One without a filter is what its source's filtered populations and every excluded
    one leave; a row of which a condition is unknown is in none of them."""
    out: dict[str, DataFrame] = {}
    for name, spec in specs.items():
        if spec["source"] == "_previous_matched":
            if previous is not None:
                out[name] = population(previous, spec) if spec.get("filter") else previous
            continue
        df = sources[spec["source"]]
        if spec.get("filter"):
            out[name] = population(df, spec)
            continue
        others = [
            s for n, s in specs.items()
            if n != name and s.get("filter") and (s["source"] == spec["source"] or s.get("action") == "exclude")
        ]
        for s in others:
            if all(c["field"] in df.columns for c in s["filter"] if "field" in c):
                df = df.where(~condition(s["filter"]))
        out[name] = df
    return out


#: Formats of dates, tried in this order.
DATE_FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy", "yyyy-M-d H:mm:ss.SSSSSS", "yyyy-M-d H:mm:ss", "yyyy-M-d")


def date_gate(df: DataFrame, field: str, years: int, as_of: dt.datetime | None = None) -> DataFrame:
    """Rows not older than that many times 365 days. The first format under which any row stays holds for all rows; if
    there is none, texts are compared as ISO dates. One aggregate counts for all formats at once."""
    cutoff = (as_of or dt.datetime.now()) - dt.timedelta(days=365 * years)
    text = column(field).cast("string")
    tests = [F.coalesce(F.try_to_timestamp(text, F.lit(f)).cast("date") >= F.lit(cutoff.date()), F.lit(False)) for f in DATE_FORMATS]
    found = df.agg(*[F.max(t).alias(f"f{i}") for i, t in enumerate(tests)]).first()
    for i, t in enumerate(tests):
        if found[f"f{i}"]:
            return df.where(t)
    return df.where(text >= F.lit(cutoff.strftime("%Y-%m-%d")))


def step_filters(spec: Mapping[str, Any]) -> list[dict[str, Any]]:
    """A step's filters with an old date_gate block rewritten as one."""
    out = [dict(f) for f in spec.get("filters") or []]
    if gate := spec.get("date_gate"):
        out.append({"field": gate["field"], "op": "max_age_years", "value": gate.get("max_age_years", 2), "applies_to": gate.get("applies_to", "destination")})
    return out


def apply_step_filter(df: DataFrame, filt: Mapping[str, Any], as_of: dt.datetime | None = None) -> DataFrame:
    if filt["op"] == "max_age_years":
        return date_gate(df, filt["field"], int(filt.get("value", 2)), as_of)
    return df.where(condition([{k: filt[k] for k in ("field", "op", "value", "values") if k in filt}]))


def excluded_values(spec: Mapping[str, Any], base_dir: str = ".") -> list[str]:
    values = [literal(v) for v in spec.get("values") or ()]
    if spec.get("file") and (path := Path(base_dir, spec["file"])).exists():
        with path.open(newline="") as f:
            values += [row[0].strip() for row in csv.reader(f) if row]
    return sorted(set(values))


def exclude(df: DataFrame, field: str, values: Sequence[str]) -> DataFrame:
    """Without the rows whose field is one of the values; rows without the field go as well once there is a value.
    Short lists are part of the expression; long ones become a table and an anti join, which Spark plans by size."""
    if not values or field not in df.columns:
        return df
    c = column(field).cast("string")
    if len(values) <= 1000:
        return df.where(~c.isin(list(values)))
    listed = df.sparkSession.createDataFrame([(v,) for v in values], "__excluded string")
    return df.where(c.isNotNull()).join(listed, c == F.col("__excluded"), "left_anti")


def read_exclusions(config: str | Mapping[str, Any], base_dir: str = ".") -> dict[str, list[str]]:
    """step -> ids, from a CSV with a step column and an id column (named, vnd_id, or the only other but notes)."""
    spec = {"file": config} if isinstance(config, str) else dict(config)
    with Path(base_dir, spec["file"]).open(newline="", encoding="utf-8-sig") as f:
        rows = list(csv.DictReader(f))
        names = list(rows[0]) if rows else []
    if not rows:
        return {}
    if "step" not in names:
        raise ValueError(f"{spec['file']}: there is no step column")
    wanted = spec.get("id_column")
    if wanted and wanted not in names:
        raise ValueError(f"{spec['file']}: there is no column {wanted}")
    rest = [n for n in names if n not in ("step", "note", "notes")]
    key = wanted or ("vnd_id" if "vnd_id" in names else rest[0] if len(rest) == 1 else None)
    if key is None:
        raise ValueError(f"{spec['file']}: name the id column")
    out: dict[str, list[str]] = {}
    for r in rows:
        if (r["step"] or "").strip() and (r[key] or "").strip():
            out.setdefault(r["step"].strip(), []).append(r[key].strip())
    return out
