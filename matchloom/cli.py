"""Command line: run a recipe, check it, or profile a file."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import re
import sys
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators import output as out_ops, profile, resolve
from .plans import pipeline, recipe as recipes
from .sinks import frames, profile_report, summary
from .sources import files


def session(name: str = "matchloom") -> SparkSession:
    return (
        SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.caseSensitive", "true")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_") or "output"


def write_output(result: pipeline.Result, output: Mapping[str, Any], path: Path, stats: Mapping[str, Any], matched: DataFrame | None = None, unmatched: DataFrame | None = None, recipe_file: str | None = None, base_dir: str = ".", chart: str = "default") -> list[Path]:
    """All artefacts of one output block; returns their paths."""
    made: list[Path] = []
    fmts, modes, views = frames.formats(output), recipes.summary_modes(output), frames.views(output)
    if matched is None:
        matched, unmatched = pipeline.presented(result, output)
    if output.get("mode") == "enriched":
        matched = pipeline.enriched(result, output, matched)
    else:
        matched = resolve.public(matched)
    merged = None
    if "merged" in views:
        merged = pipeline.merged(result)
    for fmt in fmts:
        file = path if len(fmts) == 1 else path.with_suffix(f".{fmt}")
        if fmt == "xlsx" and "xlsx" in modes:
            summary.report(file, matched, unmatched, result.recipe, stats, output, result.seconds, recipe_file, base_dir, merged if views == ["merged"] else None)
            made.append(file)
            continue
        if views != ["merged"]:
            frames.write(out_ops.map_columns(matched, output), file, fmt)
            made.append(file)
        if merged is not None:
            to = file if views == ["merged"] else file.with_name(f"{file.stem}_merged{file.suffix}")
            frames.write(merged, to, fmt)
            made.append(to)
        if unmatched is not None and ("separate" in views or (not views and output.get("emit_unmatched"))):
            to = file.with_name(f"{file.stem}_unmatched{file.suffix}")
            frames.write(frames.unmatched_export(resolve.public(unmatched), output), to, fmt)
            made.append(to)
    if "md" in modes:
        to = path.with_name(f"{path.stem}_summary.md")
        to.write_text(summary.markdown(result.recipe, stats, result.seconds, chart, recipe_file))
        made.append(to)
    return made


def run_recipe(spark: SparkSession, path: str | Path, base_dir: str = ".", output: str | None = None, as_of: dt.datetime | None = None, chart: str = "default") -> list[Path]:
    r = recipes.load(path)
    result = pipeline.run(spark, r, base_dir, as_of, write=True)
    for w in result.warnings:
        print(f"[WARN] {w}", file=sys.stderr)
    stats = result.stats()
    stamp = dt.datetime.now().strftime("%Y%m%d_%H%M%S")
    made: list[Path] = []
    if "phases" not in r:
        o = r["output"]
        to = Path(output or o.get("path") or f"output/{slug(r['name'])}_{stamp}.{frames.formats(o)[0]}")
        return write_output(result, o, to, stats, recipe_file=str(path), base_dir=base_dir, chart=chart)
    by_name = {p.name: p for p in result.phases}
    blocks = [(i, p) for i, p in enumerate(r["phases"], 1) if "output" in p]
    for i, p in blocks:
        phase = by_name.get(p.get("name", f"Phase {i}"))
        if phase is None or phase.matched is None:
            continue
        last = i == len(r["phases"])
        o = p["output"]
        base = Path(output) if output and len(blocks) == 1 else Path(o.get("path") or f"output/{slug(r['name'])}_{slug(phase.name)}_{stamp}.{frames.formats(o)[0]}")
        matched = result.matched if last else phase.matched
        made += write_output(result, o, base, stats, matched, result.unmatched if last else phase.unmatched, str(path), base_dir, chart)
    return made


def dry_run(spark: SparkSession, path: str | Path, base_dir: str = ".") -> tuple[str, bool]:
    """What a run would find wrong; reads schemas, runs nothing."""
    out = [f"Recipe: {path}"]
    try:
        r = recipes.load(path)
        warnings = recipes.validate(r)
    except ValueError as e:
        return "\n".join([*out, f"[ERROR] {e}"]), False
    sources, errors = {}, []
    for name, s in r["sources"].items():
        try:
            sources[name] = files.load(spark, s, base_dir, r["name"], name)
            out.append(f"  source {name}: {len(sources[name].columns)} columns")
        except Exception as e:  # any source can fail in its own way, and all are reported
            errors.append(f"source {name}: {str(e).splitlines()[0]}")
    groups, more, bad = recipes.read_groups(r.get("output") or {}, base_dir)
    warnings, errors = warnings + more, errors + bad
    if not errors:
        bad, more = recipes.validate_fields(r, sources, groups)
        warnings, errors = warnings + more, errors + bad
    out += [f"  population {n}: {summary.describe_filters(p)}" for n, p in recipes.populations_of(r).items()]
    out += [f"  step {i}: {s['name']} ({s['match_fields'][0].get('method', 'exact')})" for i, s in enumerate(recipes.steps_of(r), 1)]
    out += [f"[WARN] {w}" for w in warnings] + [f"[ERROR] {e}" for e in errors]
    return "\n".join([*out, "invalid" if errors else "valid"]), not errors


def analyze(spark: SparkSession, file: str, columns: str | None = None, fmt: str = "md", output: str | None = None, sections: list[str] | None = None, n: int = 15, suggest: str | None = None) -> str:
    df = files.load(spark, {"file": file})
    results = profile.analyze(df, profile.pick_columns(df, columns))
    if suggest:
        profile_report.sidecars(results, suggest)
    if fmt == "xlsx":
        to = output or f"{Path(file).stem}_signals.xlsx"
        profile_report.workbook(results, to)
        return to
    text = json.dumps(results, indent=2, default=str, ensure_ascii=False) if fmt == "json" else profile_report.markdown(results, file, sections, n)
    if output:
        Path(output).write_text(text)
        return output
    return text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    p.add_argument("--recipe", help="recipe file, YAML or JSON")
    p.add_argument("--data-dir", "--data", default=".", help="folder of the sources")
    p.add_argument("--no-libpostal", action="store_true", help="the token rules for addresses, which are the only ones here")
    p.add_argument("--output", help="path of the result")
    p.add_argument("--dry-run", action="store_true", help="check the recipe and its sources only")
    p.add_argument("--mermaid", nargs="?", const="default", choices=["default", "detailed", "disabled"], default="default")
    p.add_argument("--analyze", metavar="FILE", help="profile a file")
    p.add_argument("--columns", help="columns to profile, by commas, or auto")
    p.add_argument("--format", "--signal-format", choices=["md", "xlsx", "json", "both"], default="md", help="of a profile; both: md and xlsx")
    p.add_argument("--signal-output", metavar="FILE", help="path of a profile")
    p.add_argument("--sections", help="of the profile: " + ", ".join(profile_report.SECTIONS))
    p.add_argument("--top", type=int, default=15)
    p.add_argument("--suggest", "--save-config", metavar="DIR", help="write suggested sidecars there")
    a = p.parse_args(argv)
    if bool(a.recipe) == bool(a.analyze):
        p.error("give --recipe or --analyze")
    spark = session()
    try:
        if a.analyze:
            to, sections = a.signal_output or a.output, a.sections and [s.strip() for s in a.sections.split(",")]
            for fmt in ("md", "xlsx") if a.format == "both" else (a.format,):
                named = str(Path(to).with_suffix(f".{fmt}")) if to and a.format == "both" else to
                print(analyze(spark, a.analyze, a.columns, fmt, named, sections, a.top, a.suggest))
        elif a.dry_run:
            text, ok = dry_run(spark, a.recipe, a.data_dir)
            print(text)
            return 0 if ok else 1
        else:
            for path in run_recipe(spark, a.recipe, a.data_dir, a.output, chart=a.mermaid):
                print(path)
    except ValueError as e:
        print(f"[ERROR] {e}", file=sys.stderr)
        return 1
    return 0
