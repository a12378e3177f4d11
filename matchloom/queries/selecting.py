"""Filters, populations, date gates, tiers, exclusions, scans and sinks."""

from __future__ import annotations

import datetime as dt
import tempfile
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import clean, nfkc, normalized, raw, strip_prefix, tie_key
from ..operators import filters, resolve
from ..operators.joins import POS, with_position
from ..sinks import frames
from ..sources import files
from .base import WITH, Query, clean_sql, migrated, normalized_sql, read

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = dt.datetime(2001, 6, 30)


def register(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@register("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name <> 'Customer#000000001' AND starts_with(c_name, 'Customer#0000')")
def filter_dsl_and(spark, d):
    conds = [{"field": "c_mktsegment", "op": "eq", "value": "BUILDING"}, {"field": "c_name", "op": "neq", "value": "Customer#000000001"}, {"field": "c_name", "op": "starts_with", "value": "Customer#0000"}]
    return read(spark, d, "customer").where(filters.condition(conds)).select("c_custkey", "c_name")


@register("SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' OR contains(c_name, '77') OR (NOT starts_with(c_name, 'Customer#0'))")
def filter_dsl_or(spark, d):
    conds = [{"field": "c_mktsegment", "op": "eq", "value": "MACHINERY"}, {"field": "c_name", "op": "contains", "value": "77", "join": "or"}, {"field": "c_name", "op": "not_starts_with", "value": "Customer#0"}]
    return read(spark, d, "customer").where(filters.condition(conds)).select("c_custkey")


@register("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_name), 'gizmo')")
def filter_ignore_case(spark, d):
    conds = [{"field": "p_name", "op": "contains_any", "values": ["WIDGET", "Gizmo"], "ignore_case": True}]
    return read(spark, d, "part").where(filters.condition(conds)).select("p_partkey")


@register("SELECT doc_id, 'null' AS side FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL UNION ALL SELECT doc_id, 'set' FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND toxic::VARCHAR <> '1'")
def filter_nulls(spark, d):
    both = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    null = both.where(filters.condition([{"field": "toxic", "op": "is_null"}])).select("doc_id", F.lit("null").alias("side"))
    some = both.where(filters.condition([{"field": "toxic", "op": "is_not_null"}, {"field": "toxic", "op": "neq", "value": 1}]))
    return null.unionByName(some.select("doc_id", F.lit("set").alias("side")))


_POPS = {
    "promo": {"source": "part", "filter": [{"field": "p_type", "op": "eq", "value": "PROMO"}]},
    "garbage": {"source": "part", "filter": [{"field": "p_name", "op": "contains", "value": "rod"}], "action": "exclude"},
    "rest": {"source": "part", "filter": []},
}


@register("SELECT p_partkey, 'rest' AS pop FROM part WHERE NOT p_type = 'PROMO' AND NOT contains(p_name, 'rod') UNION ALL SELECT p_partkey, 'promo' FROM part WHERE p_type = 'PROMO'")
def population_remainder(spark, d):
    pops = filters.populations(_POPS, {"part": read(spark, d, "part")})
    return pops["rest"].select("p_partkey", F.lit("rest").alias("pop")).unionByName(pops["promo"].select("p_partkey", F.lit("promo").alias("pop")))


def _gate(spark, d, fmt, as_of=AS_OF, years=2):
    orders = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", fmt).alias("updated"))
    return filters.date_gate(orders, "updated", years, as_of).select("o_orderkey")


_CUT = (AS_OF - dt.timedelta(days=730)).date()


@register(f"SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '{_CUT}'")
def date_gate_iso(spark, d):
    return _gate(spark, d, "yyyy-MM-dd")


@register(f"SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '{_CUT}'")
def date_gate_us(spark, d):
    return _gate(spark, d, "MM/dd/yyyy HH:mm:ss")


@register(f"SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y.%m.%d') >= '{_CUT}'")
def date_gate_fallback(spark, d):
    return _gate(spark, d, "yyyy.MM.dd")


@register(f"{WITH} SELECT record_key, {clean_sql('name')} AS cleaned FROM migrated")
def tier_clean(spark, d):
    return migrated(spark, d).select("record_key", clean(F.col("name")).alias("cleaned"))


_ALIASES, _STOP = {"small": "sm", "brand": "br"}, ["inc", "economy", "promo"]


@register(f"{WITH} SELECT record_key, {normalized_sql('name', _ALIASES, _STOP)} AS norm FROM migrated")
def tier_normalized(spark, d):
    return migrated(spark, d).select("record_key", normalized(F.col("name"), _ALIASES, _STOP).alias("norm"))


@register(f"{WITH} SELECT record_key, ordinal::VARCHAR AS as_text FROM migrated")
def tier_raw(spark, d):
    return migrated(spark, d).select("record_key", raw(F.col("ordinal")).alias("as_text"))


@register("SELECT p_partkey, nfc_normalize(p_name || ' ' || 'é') AS composed FROM part")
def tier_nfkc(spark, d):
    return read(spark, d, "part").select("p_partkey", nfkc(F.concat("p_name", F.lit(" é"))).alias("composed"))


@register(f"{WITH} SELECT record_key, regexp_replace(record_key, '^[A-Za-z]+', '') AS bare, regexp_replace(parent_id, '^P1', '') AS cut, ordinal AS tie FROM migrated")
def strip_prefixes(spark, d):
    m = migrated(spark, d)
    return m.select("record_key", strip_prefix(F.col("record_key"), "alpha").alias("bare"), strip_prefix(F.col("parent_id"), "^P1").alias("cut"), tie_key(F.col("record_key"), "alpha").alias("tie"))


@register(f"{WITH} SELECT record_key FROM migrated WHERE record_key NOT IN ('V1', 'V2', 'V30', 'V700')")
def step_exclude(spark, d):
    return filters.exclude(migrated(spark, d), "record_key", ["V1", "V2", "V30", "V700"]).select("record_key")


@register(f"{WITH} SELECT record_key FROM migrated WHERE ordinal % 2 = 1 OR ordinal >= 4000")
def step_exclude_long_list(spark, d):
    return filters.exclude(migrated(spark, d), "record_key", [f"V{i}" for i in range(0, 4000, 2)]).select("record_key")


@register("SELECT p_partkey AS ordinal, p_name, row_number() OVER (ORDER BY p_partkey) AS place FROM part ORDER BY p_partkey")
def source_order_sink(spark, d):
    """All parts, dealt out by hash and put back in source order; place is where a row then stands."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), "p_name").withColumn(POS, F.col("ordinal"))
    sorted_ = resolve.public(resolve.source_order(p.repartition(7, F.hash("p_name", "ordinal")), p, "ordinal"))
    ids = sorted_.withColumn("at", F.monotonically_increasing_id())  # rises in the order of the rows
    return ids.withColumn("place", F.row_number().over(Window.orderBy("at")).cast("long")).drop("at")


def _staged(spark, d, fmt):
    folder = Path(tempfile.mkdtemp(prefix="matchloom-query-"))
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("Vendor ID"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(', "x"'))).alias("Vendor.Name"))
    frames.write(with_position(rows), folder / f"vendors.{fmt}", fmt)
    return files.load(spark, {"file": f"vendors.{fmt}"}, str(folder))


_STAGED = "SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN s_name || ', \"x\"' END AS name FROM supplier"


@register(_STAGED)
def sink_scan_csv(spark, d):
    return _staged(spark, d, "csv").toDF("id", "name")


@register(_STAGED)
def sink_scan_parquet(spark, d):
    return _staged(spark, d, "parquet").toDF("id", "name")
