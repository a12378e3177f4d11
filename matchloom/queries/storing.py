"""Sources and sinks: what is written in a format is read again, or a source is queried, beside SQL on the table it came from."""

from __future__ import annotations

import json
import sqlite3
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import address
from ..operators import filters
from ..operators.joins import POS, exact, with_position
from ..plans import pipeline, recipe as recipes
from ..sinks import frames
from ..sources import files
from .base import WITH, Query, chars, clean_sql, ratio_sql, read, trusted
from .matching import _CASCADE, RECIPE, cascade, migrated

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _folder(spark) -> Path:
    """A folder of its own among those that the driver and the executors share."""
    path = Path(files.shared_folder(spark).removeprefix("file:"))
    return files.own_folder(path, "query")


_CUSTOMERS = "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name, c_mktsegment AS segment FROM customer"


def _customers(spark, d):
    name = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), name.alias("name"), F.col("c_mktsegment").alias("segment"))


@register(_CUSTOMERS)
def scan_tsv(spark, d):
    folder = _folder(spark)
    _customers(spark, d).write.csv(str(folder / "c.tsv"), sep="\t", header=True)
    return files.load(spark, {"file": "c.tsv"}, str(folder))


@register(_CUSTOMERS)
def scan_json_lines(spark, d):
    folder = _folder(spark)
    _customers(spark, d).write.json(str(folder / "c.jsonl"), ignoreNullFields=False)
    return files.load(spark, {"file": "c.jsonl", "columns": ["id", "name", "segment"]}, str(folder))


def _made(df, write) -> list[str]:
    """What write(rows, number of the task) makes of each task's rows, in the tasks: it yields names, which come back."""

    def run(batches):
        from pyspark import TaskContext

        rows = (r for batch in batches for r in batch.to_pylist())
        for name in write(rows, TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return [r["name"] for r in df.mapInArrow(run, "name string").collect()]


@register("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def scan_json_array(spark, d):
    """Files that hold an array each, as many as there are tasks."""
    folder = _folder(spark)
    to = str(folder / "c.json")
    (folder / "c.json").mkdir()

    def write(rows, k):
        with open(f"{to}/{k:05}.json", "w") as f:
            f.write("[" + ",\n".join(json.dumps(r) for r in rows) + "]")
        yield to

    _made(read(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name").repartition(8), write)
    return files.load(spark, {"file": "c.json", "columns": ["id", "name"]}, str(folder))


@register("SELECT c_name AS name, c_custkey AS id FROM customer")
def scan_projected(spark, d):
    folder = _folder(spark)
    read(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS rest").write.parquet(str(folder / "c.parquet"))
    return files.load(spark, {"file": "c.parquet", "columns": ["name", "id"]}, str(folder))


@register("SELECT c_name AS name, n_name AS nation, (c_custkey * 2)::VARCHAR AS twice FROM customer JOIN nation ON c_nationkey = n_nationkey")
def source_sqlite(spark, d):
    """A database that a task fills and several read side by side."""
    path = str(_folder(spark) / "small.db")

    def fill(table):
        def write(rows, _):
            with sqlite3.connect(path) as db:
                db.execute(f"DROP TABLE IF EXISTS {table}")
                db.execute(f"CREATE TABLE {table} (k INTEGER, name TEXT, n INTEGER)")
                db.executemany(f"INSERT INTO {table} VALUES (?, ?, ?)", ((r["k"], r["name"], r["n"]) for r in rows))
            yield path

        return write

    _made(read(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_nationkey AS n").coalesce(1), fill("customer"))
    _made(read(spark, d, "nation").selectExpr("n_nationkey AS k", "n_name AS name", "n_regionkey AS n").coalesce(1), fill("nation"))
    query = "SELECT c.name, n.name AS nation, c.k * 2 AS twice FROM customer c JOIN nation n ON c.n = n.k"
    spec = {"loader": "sql", "driver": "sqlite", "connection": {"database": path}, "query": query, "partition": {"column": "twice", "count": 4}, "cache_ttl": "off"}
    return files.load(spark, spec)


_CUSTOMER_FILE = "SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer"


def _customer_file(spark, d) -> str:
    path = str(_folder(spark) / "customers.csv")
    frames.write(read(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name"), path, "csv")
    return path


@register(_CUSTOMER_FILE)
def source_http_zip(spark, d):
    """A zipped file behind an address that another answer names, fetched by a task."""
    path = _customer_file(spark, d)

    def pack(_, k):
        with zipfile.ZipFile(f"{path}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("read.me", "x")
            z.write(path, "data/customers.csv")
        yield path

    _made(spark.range(0, 1, 1, 1), pack)

    def get(url, *_):
        if url == "http://here/latest":
            return json.dumps({"files": [{"url": "http://here/c.zip"}]}).encode(), "application/json"
        return open(f"{path}.zip", "rb"), "application/zip"

    spec = {"loader": "http", "url_from": {"endpoint": "http://here/latest", "json_path": "files[0].url"}, "zip_entry": "data/customers.csv", "cache_ttl": "off"}
    return files.load(spark, spec, str(_folder(spark)), get=get)


@register(_CUSTOMER_FILE)
def source_cached(spark, d):
    """The second reading comes from the cache: by then the source has nothing left."""
    path, folder = _customer_file(spark, d), str(_folder(spark))
    spec = {"loader": "http", "url": "http://here/c.csv", "cache_ttl": "1h"}
    files.load(spark, spec, folder, get=lambda *_: (open(path, "rb"), "text/csv"))
    return files.load(spark, spec, folder, get=lambda *_: (b"id,name\r\n", "text/csv"))


@register(f"{_CASCADE} SELECT record_key, family, 'no_name_match' AS reason_code, NULL::VARCHAR AS rejection_step, NULL::DOUBLE AS best_rejected_score FROM migrated WHERE record_key NOT IN (SELECT record_key FROM best)")
def unmatched_companion(spark, d):
    """The file of unmatched rows, written and read again."""
    r = cascade(spark, d)
    out = frames.unmatched_export(r.unmatched, {"columns": {"analysis": [{"field": c} for c in ("record_key", "family", *frames.REASONS)]}})
    path = _folder(spark) / "unmatched.parquet"
    frames.write(out, path, "parquet", single=False)
    return spark.read.parquet(str(path)).select("record_key", "family", "reason_code", "rejection_step", "best_rejected_score")


_LISTED = "('V3', 'V4', 'V10', 'V600')"


@register(f"""{WITH}, keyed AS (SELECT *, name AS k0, {clean_sql('name')} AS k1 FROM migrated WHERE record_key NOT IN {_LISTED}), dkeyed AS (SELECT *, dest_name AS d0, {clean_sql('dest_name')} AS d1 FROM trusted),
  hits AS (SELECT record_key, dest_id, dest_ordinal, 0 AS t FROM keyed JOIN dkeyed ON k0 = d0 UNION ALL SELECT record_key, dest_id, dest_ordinal, 1 FROM (SELECT *, {clean_sql('name')} AS k1 FROM migrated) JOIN dkeyed ON k1 = d1)
  SELECT record_key, dest_id, CASE t WHEN 0 THEN 'raw' ELSE 'cleaned' END AS match_step FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY t, dest_ordinal) AS n FROM hits) WHERE n = 1""")
def exclusions_file(spark, d):
    """A global list of exclusions: its records take no part in the step that it names."""
    folder = _folder(spark)
    (folder / "out.csv").write_text("step,record,note\n" + "".join(f"raw,{x},no\n" for x in ("V3", "V4", "V10", "V600")))
    recipe = recipes.route_exclusions(RECIPE, filters.read_exclusions({"file": "out.csv", "id_column": "record"}, str(folder)))
    r = pipeline.run(spark, recipe, sources={"migrated": migrated(spark, d), "trusted": trusted(spark, d)})
    return r.matched.select("record_key", "dest_id", "match_step")


@register(f"{_CASCADE} SELECT 'matched' AS view, count(*) AS n FROM best UNION ALL SELECT 'unmatched', count(*) FROM migrated WHERE record_key NOT IN (SELECT record_key FROM best)")
def views_separate(spark, d):
    """Both views in source order, each counted."""
    matched, missed = pipeline.presented(cascade(spark, d))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n")
    return count(matched, "matched").unionByName(count(missed, "unmatched"))


# Addresses with directions, a suffix, a unit, a state and a postcode: the parts by their places in what is put together.
_PLACE = "['al', 'ca', 'fl', 'ny', 'tx']"


@register(f"""SELECT p_partkey, p_name AS street, 'blvd' AS suffix, 'suite ' || (p_size % 90)::VARCHAR AS unit, 'n' AS direction, {_PLACE}[1 + p_size % 5] AS state, (10000 + p_partkey % 80000)::VARCHAR AS zip FROM part""")
def address_parts(spark, d):
    states = F.get(F.array(*[F.lit(x) for x in ("al", "ca", "fl", "ny", "tx")]), F.col("p_size") % 5)
    text = F.concat_ws(" ", F.lit("N."), "p_name", F.lit("Blvd,"), F.lit("Suite"), (F.col("p_size") % 90).cast("string"), states, (10000 + F.col("p_partkey") % 80000).cast("string"))

    @F.pandas_udf("street string, suffix string, unit string, direction string, state string, zip string")
    def parts(texts):
        import pandas as pd

        rows = [address.classify(t) for t in texts]
        return pd.DataFrame([(a.street_name, a.street_suffix, a.unit, ",".join(a.directionals), a.state, a.zip_code) for a in rows], columns=["street", "suffix", "unit", "direction", "state", "zip"])

    return read(spark, d, "part").select("p_partkey", parts(text).alias("x")).select("p_partkey", "x.*")


@register("SELECT p_partkey, 100.0::DOUBLE AS score, true AS street_match, 'merged<>merged' AS comparison FROM part")
def address_merged(spark, d):
    """Fields cut at other places on either side: only put together they are equal."""
    p = read(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"), F.col("p_size").cast("string").alias("n"))
    src = [F.concat_ws(" ", "n", F.get("w", F.lit(0))), F.concat_ws(" ", F.get("w", F.lit(1)), F.lit("street suite 5"))]
    dst = [F.col("n"), F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.lit("street suite 5"))]
    scored = p.withColumn("x", address.score_columns(src, dst, tiers=["raw"]))
    return scored.select("p_partkey", F.round("x.score", 6).alias("score"), "x.street_match", "x.comparison")


@register("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def sink_scan_csv_folder(spark, d):
    """A result too large for one file: a folder that all tasks write, read again."""
    folder = _folder(spark)
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    frames.write(with_position(rows), folder / "c.csv", "csv", single=False)
    return files.load(spark, {"file": "c.csv"}, str(folder))


def _many_files(spark, d):
    """The parts in 150 CSV files, whose names follow the keys and whose sizes don't."""
    folder = _folder(spark)
    rows = read(spark, d, "part").select("p_partkey", "p_name")
    (rows.repartitionByRange(150, F.sqrt("p_partkey")).sortWithinPartitions("p_partkey")).write.csv(str(folder / "parts.csv"), header=True)
    return files.load(spark, {"file": "parts.csv", "multiline": False}, str(folder), positions=True)


@register("SELECT p_partkey::VARCHAR AS p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part")
def positions_many_files(spark, d):
    """Rows of many files are numbered by the files' names and the rows in them."""
    return _many_files(spark, d).select("p_partkey", F.col(POS).alias("place"))


@register("SELECT p_name AS name, min(p_partkey)::VARCHAR AS first_key FROM part GROUP BY p_name")
def first_wins_many_files(spark, d):
    """Of destinations of one name the first in 150 files."""
    names = read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return exact(names, _many_files(spark, d), "name", "p_name", ("raw",)).select("name", F.col("p_partkey").alias("first_key"))


@register(f"""WITH s AS (SELECT DISTINCT c_mktsegment AS m FROM customer), sc AS (SELECT m, n_nationkey, {ratio_sql(chars('m'), chars('n_name'))}::FLOAT AS score FROM s, nation),
  hits AS (SELECT c_custkey, 0 AS st, 100 AS score, o_orderkey AS d FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_custkey, 1, score, n_nationkey FROM customer JOIN sc ON m = c_mktsegment WHERE score >= 45)
  SELECT row_number() OVER (ORDER BY c_custkey, st, score DESC, d) AS rank, c_custkey::VARCHAR AS id, CASE st WHEN 0 THEN 'orders' ELSE 'similar' END AS step, d::VARCHAR AS dest FROM hits""")
def all_matches_order(spark, d):
    """All candidates of all customers, written in order by many tasks and read again: by customer, step, falling score, destination."""
    customers = read(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS id", "c_mktsegment AS segment", f"c_custkey AS {POS}")
    orders = read(spark, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS okey", "CAST(o_custkey AS STRING) AS cust", f"o_orderkey AS {POS}")
    nations = read(spark, d, "nation").selectExpr("CAST(n_nationkey AS STRING) AS nkey", "n_name", f"CAST(n_nationkey AS BIGINT) AS {POS}")
    step = lambda name, to, **m: {"name": name, "source": "c", "destination": to, "match_fields": [{"tiers": ["raw"]} | m]}
    recipe = {
        "name": "all", "sources": {n: {"file": n} for n in ("customers", "orders", "nations")}, "populations": {"c": {"source": "customers", "record_key": "id", "filter": []}},
        "steps": [step("orders", "orders", source="id", destination="cust", method="exact"), step("similar", "nations", source="segment", destination="n_name", method="fuzzy", scorer="ratio", threshold=45)],
        "output": {"format": "csv", "match_mode": "all_matches"},
    }
    r = pipeline.run(spark, recipe, sources={"customers": customers, "orders": orders, "nations": nations})
    folder = _folder(spark)
    frames.write(pipeline.presented(r)[0].select("id", "match_step", F.coalesce("okey", "nkey").alias("dest")), folder / "all.parquet", "parquet", single=False)
    out = files.load(spark, {"file": "all.parquet"}, str(folder), positions=True)
    place = F.col(POS) if POS in out.columns else F.monotonically_increasing_id()
    return out.select((place + 1).alias("rank"), "id", F.col("match_step").alias("step"), "dest")
