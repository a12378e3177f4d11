"""Steps, best matches, rollups, unmatched rows and enrichment."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address
from ..functions.text import column, quoted, strip, tie_key, tier
from . import filters
from .joins import DST_POS, POS, Norm, TieBreaker, exact, fuzzy, with_position


@dataclass
class StepResult:
    matched: DataFrame
    rejected: DataFrame | None  # key, reason, best_addr_score: one row per key
    excluded: dict[str, Any] | None = None


def _inherit(df: DataFrame, spec: Sequence[Mapping[str, str]]) -> DataFrame:
    for i in spec:
        names = [i["source"] + s for s in ("_dst", *(f"_dst{k}" for k in range(2, 22)))]
        found = next((n for n in [*names, i["source"]] if n in df.columns), None)
        if found:
            df = df.withColumnRenamed(found, i["as"])
    return df


def step(
    src: DataFrame, dst: DataFrame, spec: Mapping[str, Any], norm: Norm = Norm(), key: str | None = None, mode: str = "best_match",
    tie: TieBreaker | None = None, same_population: bool = False, as_of: dt.datetime | None = None, base_dir: str = ".",
    hold: Callable[[DataFrame], DataFrame] | None = None,
) -> StepResult:
    """One matching rule: exclusions, filters, the name join, address gates, inherited columns. Matches and rejections both come from the
    gated join: hold, if given, writes it down so that it runs once for both."""
    out_of = None
    if cfg := spec.get("exclude"):
        field_, values = cfg.get("field", key), filters.excluded_values(cfg, base_dir)
        if field_ and values and field_ in src.columns:
            src = filters.exclude(src, field_, values)
            out_of = {"step": spec.get("name"), "field": field_, "values": values}
    for f in filters.step_filters(spec):
        to = f.get("applies_to", "destination")
        if to in ("destination", "both"):
            dst = filters.apply_step_filter(dst, f, as_of)
        if to in ("source", "both"):
            src = filters.apply_step_filter(src, f, as_of)
    m = spec["match_fields"][0]
    options = {"tiers": m.get("tiers") or ["raw", "clean"], "norm": norm, "key": key, "mode": mode, "tie": tie, "exclude_self": key if same_population else None}
    if m.get("method", "exact") == "fuzzy":
        got = fuzzy(src, dst, m["source"], m["destination"], threshold=m.get("threshold", 80), scorer=m.get("scorer", "token_sort_ratio"), **options)
    else:
        got = exact(src, dst, m["source"], m["destination"], **options)
    rejected = None
    if a := spec.get("address_support"):
        to = [c + "_dst" if c + "_dst" in got.columns else c for c in a["destination"]]
        have = lambda names: [column(c) for c in names if c in got.columns]
        score = address.score_columns(
            have(a["source"]), have(to), tiers=a.get("tiers"), parser=a.get("parser", "auto"), aliases=dict(norm.addr_aliases),
            stopwords=list(norm.addr_stopwords), patterns=norm.addr_patterns, weight=(a.get("weights") or {}).get("street_name", 0.6),
        )
        got = got.withColumn("__addr", score).withColumns(
            {"addr_score": F.col("__addr.score"), "addr_street_match": F.col("__addr.street_match"), "addr_comparison": F.col("__addr.comparison"), "addr_tier": F.col("__addr.tier")}
        ).drop("__addr")
        street = F.lit(False) if not a.get("require_street_match") else ~F.col("addr_street_match")
        low = F.lit(False) if "threshold" not in a else F.col("addr_score") < F.lit(float(a["threshold"]))
        got = got.withColumn("__reason", F.when(street, "street_mismatch").when(low, "addr_below_threshold"))
        if key and key in got.columns and (a.get("require_street_match") or "threshold" in a):
            # Of a key's rejections the street goes first, then the last candidate's score counts.
            got = hold(got) if hold else got
            bad = got.where(F.col("__reason").isNotNull())
            last = Window.partitionBy("__rk").orderBy(F.col("__reason").desc(), F.col(DST_POS).desc())
            rejected = (
                bad.select(column(key).cast("string").alias("__rk"), "__reason", "addr_score", DST_POS)
                .withColumn("__n", F.row_number().over(last)).where("__n = 1")
                .select("__rk", F.col("__reason").alias("reason"), F.col("addr_score").alias("best_addr_score"))
            )
        got = got.where(F.col("__reason").isNull()).drop("__reason")
    return StepResult(_inherit(got.withColumn("match_step", F.lit(spec["name"])), spec.get("inherit") or []), rejected, out_of)


@dataclass
class PhaseResult:
    matched: DataFrame | None  # all candidates of all steps
    rejected: DataFrame | None
    exclusions: dict[str, dict[str, Any]] = field(default_factory=dict)


def run_steps(
    steps: Sequence[Mapping[str, Any]], pops: Mapping[str, DataFrame], sources: Mapping[str, DataFrame], norm: Norm, key: str,
    tie: TieBreaker | None = None, offset: int = 0, mode: str = "best_match", as_of: dt.datetime | None = None, base_dir: str = ".",
    hold: Callable[[DataFrame], DataFrame] | None = None,
) -> PhaseResult:
    """All steps over the full populations; nothing runs until the result is read, but for what hold writes down."""
    matched, rejected, exclusions = [], [], {}
    for i, spec in enumerate(steps):
        src = pops.get(spec["source"])
        dst = pops.get(spec["destination"], sources.get(spec["destination"]))
        if src is None or dst is None:
            continue
        r = step(src, dst, spec, norm, key, mode, tie, spec["source"] == spec["destination"], as_of, base_dir, hold)
        matched.append(r.matched.withColumn("__step", F.lit(offset + i)))
        if r.rejected is not None:
            rejected.append(r.rejected.withColumns({"step": F.lit(spec["name"]), "__step": F.lit(offset + i)}))
        if r.excluded:
            exclusions[spec["name"]] = r.excluded
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs) if dfs else None
    all_rejected = union(rejected)
    if all_rejected is not None:
        first = Window.partitionBy("__rk").orderBy("__step")
        all_rejected = all_rejected.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__step")
    return PhaseResult(union(matched), all_rejected, exclusions)


#: Of all candidates of a source row: the step's number and the destination's position.
CANDIDATE_ORDER = ("__step", DST_POS)


def best(candidates: DataFrame, key: str, mode: str = "best_match", tie: TieBreaker | None = None) -> DataFrame:
    """One match per key over all steps: the earliest step, then the best scores, then the tie-breaker. Exact matches count
    as 100 where another step is fuzzy."""
    df = candidates
    if mode == "best_match":
        order = [F.col("__step").asc()]
        # A missing score sorts first: an exact match before any fuzzy one.
        order += [F.col(c).desc_nulls_first() for c in ("name_score", "addr_score") if c in df.columns]
        if tie:
            name = tie.column + "_dst" if tie.column + "_dst" in df.columns else tie.column
            if name in df.columns:
                k = tie_key(column(name), tie.strip_prefix)
                order.append(k.desc_nulls_first() if tie.order == "desc" else k.asc_nulls_first())
        order += [F.col(DST_POS).asc(), F.col(POS).asc()]
        df = df.withColumn("__n", F.row_number().over(Window.partitionBy(column(key)).orderBy(*order))).where("__n = 1")
    if "name_score" in df.columns:
        df = df.withColumn("name_score", F.coalesce("name_score", F.lit(100.0)))
    keep = (POS, *CANDIDATE_ORDER) if mode == "all_matches" else (POS,)
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in keep])


def rollup(matched: DataFrame, buckets: Sequence[Mapping[str, Any]], norm: Norm = Norm(), step_names: Sequence[str] = ()) -> DataFrame:
    """Each group's first target, in tie-breaking order, for all of the group. The first target of each group is aggregated, with
    partial sums, and joined back, so that a group of any size is spread; rows out of scope or without a key keep their own."""
    for b in buckets:
        steps = list(step_names) if b.get("steps") is None else list(b["steps"])
        target, to = column(b["target"]), b.get("write_to", "rolled_supplier_id")
        scope = F.coalesce(F.col("match_step").isin(steps), F.lit(False)) if "match_step" in matched.columns else F.lit(False)
        group = tier(b.get("group_key_tier", "raw"), column(b["group_key"]), norm.name_aliases, norm.name_stopwords)
        df = matched.withColumn("__g", F.when(scope & (strip(group) != ""), group))
        k = tie_key(target, b.get("strip_prefix", ""))
        pos = [F.col(POS).alias("p")] if POS in df.columns else []
        keyed = df.where(F.col("__g").isNotNull()).select(F.col("__g").alias("__gk"), k.alias("__t"), F.struct(target.alias("x"), *pos).alias("__x"))
        if b.get("order", "asc") == "desc":
            # Nulls first, then the largest key; of its rows the first by target and position.
            keyed = keyed.withColumn("__null", F.col("__t").isNull())
            top = keyed.groupBy("__gk").agg(F.max("__null").alias("__n"), F.max("__t").alias("__m"))
            best = keyed.join(top, "__gk").where(F.when(F.col("__n"), F.col("__null")).otherwise(F.col("__t") == F.col("__m"))).groupBy("__gk").agg(F.min("__x").alias("__x"))
            best = best.select("__gk", F.col("__x.x").alias("__first"))
        else:
            best = keyed.groupBy("__gk").agg(F.min(F.struct("__t", "__x")).alias("__o")).select("__gk", F.col("__o.__x.x").alias("__first"))
        df = df.join(best, F.col("__g") == F.col("__gk"), "left")
        df = df.withColumn(to, F.when(F.col("__g").isNotNull(), F.coalesce("__first", target)).otherwise(target)).drop("__g", "__gk", "__first")
        matched = df.withColumn(f"{to}_changed", ~column(to).cast("string").eqNullSafe(target.cast("string")))
    return matched


def unmatched(src: DataFrame, matched_keys: DataFrame, key: str, rejected: DataFrame | None = None) -> DataFrame:
    """Source rows whose key isn't matched, with a reason. Rows without a key are never listed. matched_keys has a column
    named as key."""
    keys = matched_keys.select(column(key).cast("string").alias("__mk")).distinct()
    mine = column(key).cast("string")
    out = src.where(column(key).isNotNull()).join(keys, mine == F.col("__mk"), "left_anti")
    if rejected is None:
        return out.withColumns({"reason_code": F.lit("no_name_match"), "rejection_step": F.lit(None).cast("string"), "best_rejected_score": F.lit(None).cast("double")})
    out = out.join(rejected, mine == F.col("__rk"), "left")
    return out.select(
        *[column(c) for c in src.columns], F.coalesce("reason", F.lit("no_name_match")).alias("reason_code"), F.col("step").alias("rejection_step"), F.col("best_addr_score").alias("best_rejected_score")
    )


def enrich(source: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Every source row, with the columns that only the match has."""
    for df, name in ((source, "the source"), (matched, "the matches")):
        if key not in df.columns:
            raise ValueError(f"{name} has no column {key}; it has {', '.join(df.columns[:10])}")
    new = [c for c in matched.columns if c not in source.columns and not c.startswith("__")]
    if not new:
        return source
    order = [F.col(POS)] if POS in matched.columns else [F.lit(1)]
    first = matched.withColumn("__n", F.row_number().over(Window.partitionBy(column(key)).orderBy(*order))).where("__n = 1")
    right = first.select(column(key).alias("__ek"), *[column(c) for c in new])
    return source.join(right, column(key) == F.col("__ek"), "left").drop("__ek")


def source_order(df: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Sorted by where the key first stands in the source; keys that don't stand there come last. A key's candidates, where there are
    several, follow by step, by falling score, and by the positions of source and destination."""
    firsts = with_position(source).groupBy(column(key).cast("string").alias("__ok")).agg(F.min(POS).alias("__at"))
    # One global sort, at the sink only.
    pos = [F.col(POS)] if POS in df.columns else []
    if all(c in df.columns for c in CANDIDATE_ORDER):
        score = [F.col("name_score").desc()] if "name_score" in df.columns else []
        pos = [F.col("__step"), *score, *pos, F.col(DST_POS)]
    out = df.join(firsts, column(key).cast("string") == F.col("__ok"), "left").orderBy(F.col("__at").asc_nulls_last(), *pos)
    return out.drop("__ok", "__at")


def public(df: DataFrame) -> DataFrame:
    """Without the columns that are for inner use."""
    return df.select(*[F.col(quoted(c)) for c in df.columns if not c.startswith("__")])
