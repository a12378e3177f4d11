"""Computed columns and views of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NullType

from ..functions.text import as_number, blank_to_null, column, strip, strip_prefix

GROUP = "group"
UNMATCHED = "unmatched"
FLAG = "is_unmatched"


def _present(df: DataFrame, name: str) -> Column:
    return blank_to_null(column(name)) if name in df.columns else F.lit(None).cast("string")


def _parsed(df: DataFrame, name: str, prefix: str | None) -> tuple[Column, Column]:
    text = strip(strip_prefix(_present(df, name), None if prefix == "none" else prefix))
    return text, as_number(text)


def decision_record(df: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    """The first, least or greatest of the candidates that have a value, and which it is. Of equal ones, and where none is a
    number, the first listed wins."""
    names, how, prefix = list(cfg["candidates"]), cfg.get("select", "first"), cfg.get("strip_prefix", "alpha")
    # Each part is a column of its own first, so that it is computed once and the generated code stays small.
    made = df.withColumns({f"__v{i}": _present(df, n) for i, n in enumerate(names)})
    first = F.coalesce(*[F.when(F.col(f"__v{i}").isNotNull(), F.lit(i)) for i in range(len(names))])
    at = first
    if how in ("min", "max"):
        made = made.withColumns({f"__k{i}": _parsed(df, n, prefix)[1] for i, n in enumerate(names)})
        fold = F.least if how == "min" else F.greatest
        made = made.withColumn("__extreme", fold(*[F.col(f"__k{i}") for i in range(len(names))], F.lit(None).cast("double")))
        at = F.coalesce(*[F.when(F.col(f"__k{i}") == F.col("__extreme"), F.lit(i)) for i in range(len(names))], first)
    made = made.withColumn("__at", at)
    pick = lambda items: reduce(lambda rest, x: F.when(F.col("__at") == x[0], x[1]).otherwise(rest), reversed(list(enumerate(items))), F.lit(None).cast("string"))
    out = made.withColumns({cfg["write_to"]: pick([F.col(f"__v{i}") for i in range(len(names))]), f"{cfg['write_to']}_src": pick([F.lit(n) for n in names])})
    return out.drop("__at", "__extreme", *[f"__{c}{i}" for c in "vk" for i in range(len(names))])


def compare(df: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    """higher, lower or same: as numbers if both are, else as text; null if either is blank."""
    prefix = cfg.get("strip_prefix", "alpha")
    (a, x), (b, y) = _parsed(df, cfg["left"], prefix), _parsed(df, cfg["right"], prefix)
    made = df.withColumns({"__a": a, "__x": x, "__b": b, "__y": y})  # each computed once
    verdict = lambda p, q: F.when(F.col(p) > F.col(q), "higher").when(F.col(p) < F.col(q), "lower").otherwise("same")
    numbers = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    out = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.when(numbers, verdict("__x", "__y")).otherwise(verdict("__a", "__b")))
    return made.withColumn(cfg["output"], out).drop("__a", "__x", "__b", "__y")


def group_hit(df: DataFrame, group: Mapping[str, Any]) -> Column:
    have = [column(c).cast("string") for c in group.get("match_columns") or [] if c in df.columns]
    either = lambda tests: reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))
    tests = [c.rlike(group["regex"]) for c in have] if group.get("regex") else []
    if values := group.get("values"):
        wanted = [F.lower(strip(F.lit(str(v)))) for v in values]
        tests += [F.lower(strip(c)).isin(*wanted) for c in have]
    hit = either(tests)
    if group.get("exclude_regex"):
        hit &= ~either([c.rlike(group["exclude_regex"]) for c in have])
    return hit


def tag_groups(df: DataFrame, groups: Sequence[Mapping[str, Any]], mode: str = "all_match") -> DataFrame:
    """all_match: the sorted names of all groups that apply. first_match: the first in order, or null."""
    named = [F.when(group_hit(df, g), F.lit(g["group_name"])) for g in groups]
    if mode == "first_match":
        return df.withColumn(GROUP, F.coalesce(*named, F.lit(None).cast("string")))
    tags = F.array(*named) if named else F.array().cast("array<string>")
    return df.withColumn(GROUP, F.array_sort(F.filter(tags, lambda x: x.isNotNull())))


def computed_names(output: Mapping[str, Any]) -> list[str]:
    out = []
    if to := (output.get("decision_record") or {}).get("write_to"):
        out += [to, f"{to}_src"]
    out += [c["output"] for c in output.get("compare_columns") or []]
    return out + [GROUP] * bool(output.get("groups"))


def _wanted(output: Mapping[str, Any], key: str) -> list[dict[str, Any]]:
    return [e for e in (output.get("columns") or {}).get(key) or [] if isinstance(e, dict)]


def compute(df: DataFrame, output: Mapping[str, Any], groups: Sequence[Mapping[str, Any]] = ()) -> DataFrame:
    """Group tags, then the decision record and comparisons; those that the output's columns don't name go again."""
    if groups and output.get("groups"):
        df = tag_groups(df, groups, output["groups"].get("mode", "all_match"))
    made = df
    if (d := output.get("decision_record")) and d.get("write_to"):
        made = decision_record(made, d)
    for c in output.get("compare_columns") or []:
        made = compare(made, c)
    named = {f for e in _wanted(output, "matched") for f in [e.get("field"), *(e.get("fields") or [])]}
    return made.drop(*[c for c in computed_names(output) if c not in named])


def map_columns(df: DataFrame, output: Mapping[str, Any], key: str = "matched", coalesce: bool = False) -> DataFrame:
    """Selected and renamed by the output's columns. Of several fields the first that exists, or (for reports) the first
    that has a value. Without a mapping all columns stay."""
    cols = []
    for e in _wanted(output, key):
        names = [n for n in [e.get("field"), *(e.get("fields") or [])] if n and n in df.columns]
        if names:
            c = F.coalesce(*[column(n).cast("string") for n in names]) if coalesce and len(names) > 1 else column(names[0])
            cols.append(c.alias(e.get("header") or names[0]))
    return df.select(*cols) if cols else df


def merged_view(matched: DataFrame, unmatched: DataFrame | None, derived: Sequence[str] = ()) -> DataFrame:
    """Matched and unmatched rows under the matched columns, with a flag. Columns that steps derive stay null for unmatched rows,
    whatever the source has under their names."""
    out = matched.withColumn(FLAG, F.lit(False))
    if unmatched is None:
        return out
    kinds = dict(zip(matched.columns, (f.dataType for f in matched.schema.fields), strict=True))
    cols = []
    for name, kind in kinds.items():
        if name == "match_step":
            c = F.lit(UNMATCHED)
        elif name in unmatched.columns and name not in derived:
            c = column(name)
        else:
            c = F.lit(None)
        cols.append((c if isinstance(kind, NullType) else c.cast(kind)).alias(name))
    return out.unionByName(unmatched.select(*cols, F.lit(True).alias(FLAG)))


def flatten(df: DataFrame, sep: str = ";") -> DataFrame:
    """Arrays as joined text, for formats that hold none."""
    lists = {f.name: F.array_join(column(f.name).cast("array<string>"), sep) for f in df.schema.fields if isinstance(f.dataType, ArrayType)}
    return df.withColumns(lists) if lists else df
