"""What a run leaves behind: files in every format, workbooks, summaries and profiles, written by the command line's code and read again."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path

import yaml
from pyspark.sql import functions as F

from .. import cli
from ..operators.joins import POS
from ..plans import pipeline
from ..sinks import frames, summary, xlsx
from ..sources import files
from .base import WITH, Query, chars, clean_sql, migrated, ratio_sql, read, trusted
from .matching import _CASCADE, _CHAIN, _STEP2, RECIPE

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _run(spark, d, **over) -> tuple[Path, list[Path]]:
    """The cascade's recipe with changes, as a file, over its tables as files."""
    folder = files.own_folder(Path(files.shared_folder(spark).removeprefix("file:")), "run")
    for name, df in (("migrated", migrated(spark, d)), ("trusted", trusted(spark, d))):
        df.drop(POS).write.parquet(str(folder / f"{name}.parquet"))
    recipe = RECIPE | {"sources": {n: {"file": f"{n}.parquet"} for n in ("migrated", "trusted")}} | over
    recipe["output"] = RECIPE["output"] | (over.get("output") or {})
    (folder / "recipe.yaml").write_text(yaml.safe_dump(recipe, sort_keys=False))
    return folder, cli.run_recipe(spark, folder / "recipe.yaml", str(folder), str(folder / "out.csv"))


_COLUMNS = {"matched": [{"field": "record_key", "header": "Record"}, {"field": "dest_id"}, {"field": "match_step"}]}
_BEST = "SELECT record_key, dest_id, CASE t WHEN 0 THEN 'raw' ELSE 'cleaned' END AS match_step FROM best"


@register(f"{_CASCADE}, b AS ({_BEST}) SELECT f AS format, record_key AS record, dest_id, match_step FROM b, (SELECT unnest(['csv', 'parquet', 'xlsx']) AS f)")
def report_formats(spark, d):
    """A result in three formats at once, under its output's columns."""
    _, made = _run(spark, d, output={"format": ["csv", "parquet", "xlsx"], "columns": _COLUMNS})
    at = {p.suffix[1:]: p for p in made}
    frames_ = {"csv": files.load(spark, {"file": str(at["csv"])}), "parquet": spark.read.parquet(str(at["parquet"])), "xlsx": frames.read_table(spark, at["xlsx"], "Data")}
    out = [df.select(F.lit(f).alias("format"), F.col("Record").alias("record"), "dest_id", "match_step") for f, df in frames_.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# Records of amount 50 are listed as excluded from the first step.
_LISTED = f"""{WITH}, k AS (SELECT *, name AS k0, {clean_sql('name')} AS k1 FROM migrated), g AS (SELECT *, dest_name AS d0, {clean_sql('dest_name')} AS d1 FROM trusted),
  hits AS (SELECT record_key, 0 AS t FROM k JOIN g ON k0 = d0 WHERE amount <> '50' UNION ALL SELECT record_key, 1 FROM k JOIN g ON k1 = d1), best AS (SELECT record_key, min(t) AS t FROM hits GROUP BY record_key),
  n AS (SELECT count(*) AS m, count(*) FILTER (t = 0) AS a, (SELECT count(*) FROM migrated) AS total, (SELECT count(*) FROM migrated WHERE amount = '50') AS x FROM best)"""


@register(f"""{_LISTED} SELECT unnest(['Matched', 'Analysis', 'Exclusions', 'summary: total', 'summary: matched', 'summary: unmatched', 'summary: step 1', 'summary: step 2', 'recipe']) AS what,
  unnest([m, total - m, x, total, m, total - m, a, m - a, 1]) AS n FROM n""")
def report_workbook(spark, d):
    """The formatted report: rows of its tabs, figures of its summary, the sidecar of exclusions, the recipe that reads back equal."""
    shared = files.own_folder(Path(files.shared_folder(spark).removeprefix("file:")), "listed")
    frames.write(migrated(spark, d).where("amount = '50'").select(F.lit("raw").alias("step"), F.col("record_key").alias("record")), shared / "out.csv", "csv")
    folder, made = _run(spark, d, exclusions={"file": str(shared / "out.csv"), "id_column": "record"}, output={"format": "xlsx", "summary": ["xlsx"], "matched_unmatched": ["separate"]})
    file = next(p for p in made if p.exists() and zipfile.is_zipfile(p))
    rows = [(tab, frames.read_table(spark, file, tab).count()) for tab in ("Matched", "Analysis", "Exclusions")]
    book = {tab: list(xlsx.rows(file, tab)) for tab in ("Summary", "Recipe")}
    figures = {r[0]: r[1] for r in book["Summary"] if len(r) > 1 and isinstance(r[0], str)}
    rows += [("summary: total", int(figures["Source records"])), ("summary: matched", int(figures["Matched"])), ("summary: unmatched", int(figures["Unmatched"]))]
    head = next(i for i, r in enumerate(book["Summary"]) if r and r[0] == summary.STEP_HEADER[0])
    at = summary.STEP_HEADER.index("Matched")
    rows += [(f"summary: step {k}", int(book["Summary"][head + k][at])) for k in (1, 2)]
    echoed = summary.read_echo("\n".join(r[0] if r else "" for r in book["Recipe"]))
    rows.append(("recipe", int([s["name"] for s in echoed["steps"]] == ["raw", "cleaned"] and echoed["name"] == "cascade")))
    return spark.createDataFrame(rows, "what string, n long")


@register(f"""{_CASCADE}, n AS (SELECT count(*) FILTER (t = 0) AS a, count(*) FILTER (t = 1) AS b, (SELECT count(*) FROM migrated) AS total FROM best)
  SELECT unnest([1, 2])::BIGINT AS step, unnest([a, b]) AS matched, unnest([total - a, total - a - b]) AS leftover FROM n UNION ALL SELECT 0, a + b, total - a - b FROM n""")
def report_markdown(spark, d):
    """The steps' table and the totals of the summary in markdown."""
    folder, made = _run(spark, d, output={"summary": ["md"]})
    text = next(p for p in made if p.suffix == ".md").read_text()
    table = [[c.strip() for c in line.strip("|").split("|")] for line in text.splitlines() if line.startswith("| ")]
    m, left = (summary.STEP_HEADER.index(c) for c in ("Matched", "Leftover"))
    rows = [(k, int(r[m]), int(r[left])) for k, r in enumerate(table[1:], 1)]
    rows.append((0, int(re.search(r"\*\*Matched:\*\* (\d+)", text)[1]), int(re.search(r"\*\*Unmatched:\*\* (\d+)", text)[1])))
    return spark.createDataFrame(rows, "step long, matched long, leftover long")


@register(f"""{_CHAIN} SELECT p AS phase, okey, CASE WHEN p = 'nations' THEN n_name END AS nation FROM o JOIN c ON o_custkey = c_custkey LEFT JOIN n ON c_nationkey = n_nationkey, (SELECT unnest(['customers', 'nations']) AS p)""")
def phase_outputs(spark, d):
    """Each phase's own output, written and read again."""
    folder = files.own_folder(Path(files.shared_folder(spark).removeprefix("file:")), "phases")
    read(spark, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS okey", "CAST(o_custkey AS STRING) AS cust").write.parquet(str(folder / "orders.parquet"))
    read(spark, d, "customer").selectExpr("CASE WHEN c_custkey % 3 = 0 THEN 'old ' ELSE '' END || CAST(c_custkey AS STRING) AS ckey", "CAST(c_nationkey AS STRING) AS nation").write.parquet(str(folder / "customers.parquet"))
    read(spark, d, "nation").selectExpr("CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'old ' END || CAST(n_nationkey AS STRING) AS nkey", "n_name AS nation_name").write.parquet(str(folder / "nations.parquet"))
    step = lambda name, src, to, a, b: {"name": name, "source": src, "destination": to, "match_fields": [{"source": a, "destination": b, **_STEP2}]}
    recipe = {
        "name": "chain", "sources": {n: {"file": f"{n}.parquet"} for n in ("orders", "customers", "nations")},
        "phases": [
            {"name": "customers", "populations": {"o": {"source": "orders", "record_key": "okey"}}, "steps": [step("to customer", "o", "customers", "cust", "ckey")], "output": {"format": "parquet", "path": str(folder / "one.parquet")}},
            {"name": "nations", "populations": {"p": {"source": "_previous_matched", "record_key": "okey"}}, "steps": [step("to nation", "p", "nations", "nation", "nkey")], "output": {"format": "parquet", "path": str(folder / "two.parquet")}},
        ],
    }
    (folder / "recipe.yaml").write_text(yaml.safe_dump(recipe, sort_keys=False))
    made = cli.run_recipe(spark, folder / "recipe.yaml", str(folder))
    one, two = (spark.read.parquet(str(p)) for p in made)
    null = F.lit(None).cast("string")
    return one.select(F.lit("customers").alias("phase"), "okey", null.alias("nation")).unionByName(two.select(F.lit("nations").alias("phase"), "okey", F.col("nation_name").alias("nation")))


@register("""WITH c AS (SELECT c_name AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'n' || (c_nationkey % 7) END AS code FROM customer)
  SELECT 'name' AS col, count(*) AS total, count(*) - count(name) AS nulls, count(DISTINCT name) AS uniques FROM c UNION ALL SELECT 'segment', count(*), count(*) - count(segment), count(DISTINCT segment) FROM c
  UNION ALL SELECT 'code', count(*), count(*) - count(code), count(DISTINCT code) + 1 FROM c""")
def profile_workbook(spark, d):
    """The profiler's workbook, from a file: its summary of columns."""
    folder = files.own_folder(Path(files.shared_folder(spark).removeprefix("file:")), "profile")
    code = "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'n' || CAST(c_nationkey % 7 AS STRING) END AS code"
    read(spark, d, "customer").selectExpr("c_name AS name", "c_mktsegment AS segment", code).write.parquet(str(folder / "c.parquet"))
    to = cli.analyze(spark, str(folder / "c.parquet"), "name,segment,code", "xlsx", str(folder / "signals.xlsx"))
    head, *rows = xlsx.rows(to, "Summary")
    at = [head.index(c) for c in ("column", "total_rows", "null_count", "unique_count")]
    return spark.createDataFrame([(r[at[0]], *(int(r[k]) for k in at[1:])) for r in rows], "col string, total long, nulls long, uniques long")


@register(f"{_CASCADE} SELECT unnest(['record_key', 'decided', 'match_step']) AS col, count(*) AS n FROM best")
def pruned_columns(spark, d):
    """Of two computed columns the one that the output's columns name stays."""
    computed = {"decision_record": {"candidates": ["derived_id", "parent_id"], "write_to": "decided"}, "compare_columns": [{"left": "amount", "right": "limit_amount", "output": "over"}]}
    columns = {"matched": [{"field": "record_key"}, {"field": "decided"}, {"field": "match_step"}]}
    _, made = _run(spark, d, output=computed | {"format": "parquet", "columns": columns})
    out = spark.read.parquet(str(made[0]))
    return out.select(F.explode(F.array(*[F.lit(c) for c in out.columns])).alias("col")).groupBy("col").agg(F.count("*").alias("n"))


@register(f"""WITH p AS (SELECT p_partkey, CASE WHEN length(p_name) % 2 = 0 THEN p_name ELSE p_name || 's' END AS a FROM part), a AS (SELECT DISTINCT a FROM p), names AS (SELECT DISTINCT p_name AS b FROM part),
  s AS (SELECT a, b, {ratio_sql(chars('a'), chars('b'))}::FLOAT::DOUBLE AS score FROM a, names), best AS (SELECT a, max(score) AS score, max(a = b) AS same FROM s WHERE score >= 85 GROUP BY a)
  SELECT p_partkey::VARCHAR AS id, CASE WHEN same THEN 'same' ELSE 'near' END AS step, round(CASE WHEN same THEN 100 ELSE score END, 4) AS score FROM p JOIN best USING (a)""")
def score_fill(spark, d):
    """Exact matches count as 100 beside those of a fuzzy step."""
    p = read(spark, d, "part")
    parts = p.selectExpr("CAST(p_partkey AS STRING) AS id", "CASE WHEN length(p_name) % 2 = 0 THEN p_name ELSE p_name || 's' END AS name", f"p_partkey AS {POS}")
    names = p.groupBy(F.col("p_name").alias("target")).agg(F.min("p_partkey").alias(POS))
    step = lambda name, **m: {"name": name, "source": "all", "destination": "names", "match_fields": [{"source": "name", "destination": "target", "tiers": ["raw"]} | m]}
    recipe = {
        "name": "fill", "sources": {"parts": {"file": "parts"}, "names": {"file": "names"}}, "populations": {"all": {"source": "parts", "record_key": "id", "filter": []}},
        "steps": [step("same", method="exact"), step("near", method="fuzzy", scorer="ratio", threshold=85)], "output": {"format": "csv"},
    }
    r = pipeline.run(spark, recipe, sources={"parts": parts, "names": names})
    return r.matched.select("id", F.col("match_step").alias("step"), F.round("name_score", 4).alias("score"))


@register(f"""{WITH}, h AS (SELECT name, dest_id, dest_ordinal FROM migrated JOIN trusted ON {clean_sql('name')} = {clean_sql('dest_name')} WHERE supplier_id LIKE 'S10%')
  SELECT name, arg_min(dest_id, dest_ordinal) AS dest_id FROM h GROUP BY name""")
def recipe_file_defaults(spark, d):
    """A recipe read from a file: step defaults merged into its step, and no record key, so that the matched field is the key."""
    step = {"name": "one", "source": "all", "destination": "trusted", "match_fields": [{"source": "name", "destination": "dest_name", "method": "exact", "tiers": ["clean"]}]}
    over = {"populations": {"all": {"source": "migrated", "filter": []}}, "step_defaults": {"filters": [{"field": "supplier_id", "op": "starts_with", "value": "S10"}]}, "steps": [step]}
    _, made = _run(spark, d, **over, output={"format": "parquet", "tie_breaker": {"column": "dest_id", "strip_prefix": "alpha"}})
    return spark.read.parquet(str(made[0])).select("name", "dest_id")
