"""Running recipes: sources, populations, steps, resolution, phases, views."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import column
from ..operators import filters, output as out_ops, resolve
from ..operators.joins import POS, Norm, TieBreaker, with_position
from ..sources import files
from . import recipe as recipes
from .recipe import RecipeError


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of what several readers use: a table in the folder all executors share (spark.checkpoint.dir)."""
    spark = df.sparkSession
    path = f"{files.shared_folder(spark)}/phase-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, steps: Sequence[str] = ()) -> tuple[DataFrame, Counts]:
    """As ``cut``, with the table's rows, and those of each step, counted while they are written: by the tasks that write them, whose
    counts Spark takes once even if a task runs again. No job counts them afterwards."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    named = [F.count(F.when(F.col("match_step") == s, 1)).alias(f"s{i}") for i, s in enumerate(steps)] if "match_step" in df.columns else []
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *named))
    got = seen.get
    return table, Counts(got["n"], {s: got[f"s{i}"] for i, s in enumerate(steps[: len(named)]) if got[f"s{i}"]})


@dataclass
class Counts:
    rows: int = 0
    steps: dict[str, int] = field(default_factory=dict)


def counted(df: DataFrame | None) -> Counts:
    """By jobs, for frames that haven't been written."""
    if df is None:
        return Counts()
    steps = {r["match_step"]: r["count"] for r in df.groupBy("match_step").count().collect()} if "match_step" in df.columns else None
    return Counts(df.count(), {}) if steps is None else Counts(sum(steps.values()), steps)


@dataclass
class Phase:
    name: str
    matched: DataFrame | None
    unmatched: DataFrame | None
    input: DataFrame | None
    exclusions: dict[str, Any] = field(default_factory=dict)
    counts: Counts | None = None  # of the matches, where they were observed
    input_rows: int | None = None  # where the rows before it were observed


@dataclass
class Result:
    """Frames of a run. They are lazy, and ``stats()`` counts them by jobs, unless the run was written: then they are tables, each made
    once, and the counts are those observed meanwhile."""

    matched: DataFrame
    unmatched: DataFrame
    source: DataFrame
    key: str
    recipe: dict[str, Any]
    warnings: list[str] = field(default_factory=list)
    exclusions: dict[str, Any] = field(default_factory=dict)
    phases: list[Phase] = field(default_factory=list)
    sources: dict[str, DataFrame] = field(default_factory=dict)
    groups: list[dict[str, Any]] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    matched_counts: Counts | None = None
    unmatched_counts: Counts | None = None

    def stats(self) -> dict[str, Any]:
        """Counts for reports."""
        matched = self.matched_counts or counted(self.matched)
        # Without a match_step column nothing is matched.
        rows = matched.rows if "match_step" in self.matched.columns else 0
        out = {"total_source": self.source.count(), "matched_count": rows, "unmatched_count": (self.unmatched_counts or counted(self.unmatched)).rows, "step_counts": matched.steps, "exclusions": self.exclusions}
        if self.phases:
            out["phases"] = []
            for p in self.phases:
                c = p.counts or counted(p.matched)
                n = p.input_rows if p.input_rows is not None else p.input.count() if p.input is not None else 0
                out["phases"].append({"name": p.name, "input_count": n, "matched_count": c.rows, "step_counts": c.steps, "exclusions": p.exclusions})
        return out


def record_key(steps: list[dict[str, Any]], pops: Mapping[str, Mapping[str, Any]], frames: Mapping[str, DataFrame]) -> tuple[str, list[str]]:
    """The first step's source's record key, else its match field."""
    first = steps[0]
    key = (pops.get(first["source"]) or {}).get("record_key")
    warnings = []
    if not key:
        key = first["match_fields"][0]["source"]
        warnings.append(f"population {first['source']!r} has no record_key; {key!r} is used")
    df = frames.get(first["source"])
    if df is not None and key not in df.columns:
        raise RecipeError(f"record_key {key!r} is not a column of {first['source']!r}")
    return key, warnings


def _norm(recipe: Mapping[str, Any], base_dir: str) -> tuple[Norm, list[str]]:
    values, warnings = recipes.normalization(recipe.get("normalization"), base_dir)
    return Norm(**values), warnings


def _empty(spark: SparkSession, like: DataFrame | None = None) -> DataFrame:
    return like.limit(0) if like is not None else spark.createDataFrame([], "match_step string")


def run(spark: SparkSession, recipe: Mapping[str, Any], base_dir: str = ".", as_of: dt.datetime | None = None, sources: Mapping[str, DataFrame] | None = None, write: bool = False) -> Result:
    """Builds the plan of a recipe. Frames given as sources are used in place of loading. With write every step's join runs once, its
    rows are written to the shared folder and counted on the way, and whatever is made of the result reads these tables."""
    began = time.time()
    recipe = dict(recipe)
    warnings = recipes.validate(recipe)
    if recipe.get("exclusions"):
        recipe = recipes.route_exclusions(recipe, filters.read_exclusions(recipe["exclusions"], base_dir))
    given = dict(sources or {})
    loaded = {n: with_position(given[n] if n in given else files.load(spark, s, base_dir, recipe.get("name", ""), n, positions=True)) for n, s in recipe["sources"].items()}
    norm, more = _norm(recipe, base_dir)
    warnings += more
    groups, more, errors = recipes.read_groups(recipe.get("output") or {}, base_dir)
    warnings += more
    errors += recipes.missing_filter_fields(recipe, loaded)
    bad, more = recipes.validate_fields(recipe, {n: resolve.public(df) for n, df in loaded.items()}, groups)
    warnings += more
    if errors + bad:
        raise RecipeError("\n".join(errors + bad))
    load_s = time.time() - began
    make = _phases if "phases" in recipe else _single
    out = make(spark, recipe, loaded, norm, as_of, base_dir, write)
    out.warnings, out.sources, out.groups = warnings + out.warnings, loaded, groups
    out.seconds = {"load": load_s, "match" if write else "plan": time.time() - began - load_s}
    return out


def _single(spark: SparkSession, recipe: dict[str, Any], loaded: Mapping[str, DataFrame], norm: Norm, as_of: dt.datetime | None, base_dir: str, write: bool) -> Result:
    output, steps = recipe["output"], recipe["steps"]
    pops = filters.populations(recipe["populations"], loaded)
    key, warnings = record_key(steps, recipe["populations"], pops)
    mode, tie = output.get("match_mode", "best_match"), TieBreaker.of(output.get("tie_breaker"))
    r = resolve.run_steps(steps, pops, loaded, norm, key, tie, 0, mode, as_of, base_dir, cut if write else None)
    source = pops[steps[0]["source"]]
    if r.matched is None:
        matched = _empty(spark, source).withColumn("match_step", F.lit(None).cast("string"))
    else:
        matched = resolve.best(r.matched, key, mode, tie)
        if output.get("final_rollup"):
            matched = resolve.rollup(matched, output["final_rollup"], norm, [s["name"] for s in steps])
    if not write:
        return Result(matched, resolve.unmatched(source, matched, key, r.rejected), source, key, recipe, warnings, r.exclusions)
    matched, found = cut_counted(matched, [x["name"] for x in steps])
    missed, lost = cut_counted(resolve.unmatched(source, matched, key, r.rejected))
    return Result(matched, missed, source, key, recipe, warnings, r.exclusions, matched_counts=found, unmatched_counts=lost)


def _phases(spark: SparkSession, recipe: dict[str, Any], loaded: Mapping[str, DataFrame], norm: Norm, as_of: dt.datetime | None, base_dir: str, write: bool) -> Result:
    """Each phase's matches are written out once and feed the next; the last phase's rows are joined by those of the first
    that later phases lost, with nulls for what they never got."""
    phases: list[Phase] = []
    previous: DataFrame | None = None
    first: DataFrame | None = None
    first_key, first_source, offset = None, None, 0
    rejections: list[DataFrame] = []
    keys: list[DataFrame] = []
    exclusions: dict[str, Any] = {}
    warnings: list[str] = []
    before: Counts | None = None
    for i, p in enumerate(recipe["phases"]):
        name, steps = p.get("name", f"Phase {i + 1}"), p.get("steps") or []
        if not steps:
            warnings.append(f"{name} has no steps")
            continue
        pops = filters.populations(p.get("populations") or {}, loaded, previous)
        source = pops.get(steps[0]["source"])
        if source is None or source.isEmpty():
            phases.append(Phase(name, None, None, source))
            previous, offset, before = None, offset + len(steps), None
            continue
        key, more = record_key(steps, p.get("populations") or {}, pops)
        warnings += more
        if first_key is None:
            first_key, first_source = key, source
        r = resolve.run_steps(steps, pops, loaded, norm, key, None, offset, "best_match", as_of, base_dir, cut if write else None)
        matched, found = None, None
        if r.matched is not None:
            matched = resolve.best(r.matched, key)
            # Positions stay those of the first phase's source, so that results keep its order.
            matched, found = cut_counted(matched, [x["name"] for x in steps])
            if first_key in matched.columns:
                keys.append(matched.select(column(first_key)))
            if i == 0:
                first = matched
        if r.rejected is not None:
            rejections.append(r.rejected.withColumn("__phase", F.lit(i)))
        exclusions |= r.exclusions
        missed = resolve.unmatched(source, matched if matched is not None else source.limit(0), key, r.rejected)
        # The rows of a phase are those of the one before, unless its population filters them.
        whole = before is not None and all(x.get("source") == "_previous_matched" and not x.get("filter") for x in [(p.get("populations") or {}).get(steps[0]["source"]) or {}])
        phases.append(Phase(name, matched, missed, source, r.exclusions, found, before.rows if whole else None))
        previous, offset, before = matched, offset + len(steps), found
    if first_source is None:
        raise RecipeError("no phase has rows to match")
    final = previous if previous is not None else _empty(spark, first)
    if first is not None and previous is not None and first_key in final.columns and not final.isEmpty():
        have = final.select(column(first_key).cast("string").alias("__fk")).distinct()
        lost = first.join(have, column(first_key).cast("string") == F.col("__fk"), "left_anti")
        final = final.unionByName(lost.select(*[column(c) for c in lost.columns if c in final.columns]), allowMissingColumns=True)
    rejected = None
    if rejections:
        both = reduce(lambda a, b: a.unionByName(b), rejections)
        latest = Window.partitionBy("__rk").orderBy(F.col("__phase").desc())
        rejected = both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__phase")
    all_keys = None
    for k in keys:
        all_keys = k if all_keys is None else all_keys.unionByName(k)
    unmatched = resolve.unmatched(first_source, all_keys if all_keys is not None else first_source.limit(0), first_key, rejected)
    out = Result(final, unmatched, first_source, first_key, recipe, warnings, exclusions, phases)
    if write:
        out.matched, out.matched_counts = cut_counted(final, [s["name"] for s in recipes.steps_of(recipe)])
        out.unmatched, out.unmatched_counts = cut_counted(unmatched)
    return out


def presented(result: Result, output: Mapping[str, Any] | None = None) -> tuple[DataFrame, DataFrame]:
    """Matched and unmatched rows in source order, with computed columns."""
    output = result.recipe.get("output") or {} if output is None else output
    matched, missed = (out_ops.compute(df, output, result.groups) for df in (result.matched, result.unmatched))
    return tuple(resolve.source_order(df, result.source, result.key) for df in (matched, missed))


def merged(result: Result) -> DataFrame:
    output = result.recipe.get("output") or {}
    matched, missed = presented(result)
    derived = [c for c in recipes.derived_columns(result.recipe) if c not in out_ops.computed_names(output)]
    m = resolve.public(matched)
    both = out_ops.merged_view(m, missed, derived)
    return out_ops.map_columns(both, {"columns": {"matched": [*((output.get("columns") or {}).get("matched") or []), {"field": out_ops.FLAG}]}}) if (output.get("columns") or {}).get("matched") else both


def enriched(result: Result, output: Mapping[str, Any], matched: DataFrame | None = None) -> DataFrame:
    source = result.sources[output["enrich_source"]]
    got = resolve.enrich(source, result.matched if matched is None else matched, output["enrich_key"])
    return got.orderBy(POS) if POS in got.columns else got
