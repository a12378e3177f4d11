"""Computed columns and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import output
from ..plans import pipeline
from .base import WITH, Query, migrated, read
from .matching import _CASCADE, cascade

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _sides(spark, d):
    c = read(spark, d, "customer").selectExpr("c_custkey", "c_nationkey", "CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE 'C' || CAST(c_custkey % 100 AS STRING) END AS left_id")
    s = read(spark, d, "supplier").selectExpr("s_suppkey AS paired", "CASE WHEN s_suppkey % 5 = 0 THEN 'n/a' ELSE 'S' || CAST(s_suppkey * 3 AS STRING) END AS right_id")
    return c.join(s, F.col("c_custkey") == F.col("paired"), "left")


_SIDES = """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'C' || (c_custkey % 100)::VARCHAR END AS l, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 100 END AS ln,
    CASE WHEN s_suppkey IS NULL THEN NULL WHEN s_suppkey % 5 = 0 THEN 'n/a' ELSE 'S' || (s_suppkey * 3)::VARCHAR END AS r, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 3 END AS rn
  FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey)"""


@register(f"{_SIDES} SELECT c_custkey, coalesce(l, r) AS decided, CASE WHEN l IS NOT NULL THEN 'left_id' WHEN r IS NOT NULL THEN 'right_id' END AS decided_src FROM x")
def decision_first(spark, d):
    return output.decision_record(_sides(spark, d), {"candidates": ["left_id", "right_id"], "write_to": "decided"}).select("c_custkey", "decided", "decided_src")


def _extreme(op):
    return f"""{_SIDES} SELECT c_custkey, CASE WHEN ln IS NOT NULL AND (rn IS NULL OR ln {op}= rn) THEN l WHEN rn IS NOT NULL THEN r ELSE coalesce(l, r) END AS decided,
      CASE WHEN ln IS NOT NULL AND (rn IS NULL OR ln {op}= rn) THEN 'left_id' WHEN rn IS NOT NULL THEN 'right_id' WHEN l IS NOT NULL THEN 'left_id' WHEN r IS NOT NULL THEN 'right_id' END AS decided_src FROM x"""


@register(_extreme("<"))
def decision_min(spark, d):
    return output.decision_record(_sides(spark, d), {"candidates": ["left_id", "right_id"], "write_to": "decided", "select": "min"}).select("c_custkey", "decided", "decided_src")


@register(_extreme(">"))
def decision_max(spark, d):
    return output.decision_record(_sides(spark, d), {"candidates": ["left_id", "right_id"], "write_to": "decided", "select": "max"}).select("c_custkey", "decided", "decided_src")


@register(f"""{_SIDES}, y AS (SELECT *, regexp_replace(l, '^[A-Za-z]+', '') AS ls, regexp_replace(r, '^[A-Za-z]+', '') AS rs FROM x)
  SELECT c_custkey, CASE WHEN l IS NULL OR r IS NULL THEN NULL WHEN ln IS NOT NULL AND rn IS NOT NULL THEN CASE WHEN ln > rn THEN 'higher' WHEN ln < rn THEN 'lower' ELSE 'same' END
    WHEN ls > rs THEN 'higher' WHEN ls < rs THEN 'lower' ELSE 'same' END AS verdict FROM y""")
def compare_columns(spark, d):
    return output.compare(_sides(spark, d), {"left": "left_id", "right": "right_id", "output": "verdict"}).select("c_custkey", "verdict")


GROUPS = [
    {"group_name": "round", "regex": "(?i)ring|rod", "match_columns": ["family"], "exclude_regex": "^old"},
    {"group_name": "cheap", "values": [" economy ", "SMALL"], "match_columns": ["kind", "absent"]},
    {"group_name": "blue", "regex": "^blue", "match_columns": ["family"]},
]
_HITS = f"""{WITH}, h AS (SELECT record_key, coalesce(regexp_matches(lower(family), 'ring|rod') AND NOT starts_with(family, 'old'), false) AS a,
  coalesce(lower(trim(kind)) IN ('economy', 'small'), false) AS b, coalesce(starts_with(family, 'blue'), false) AS c FROM migrated)"""


@register(f"{_HITS} SELECT record_key, array_to_string(list_sort(list_filter([CASE WHEN a THEN 'round' END, CASE WHEN b THEN 'cheap' END, CASE WHEN c THEN 'blue' END], lambda x: x IS NOT NULL)), ';') AS tags FROM h")
def groups_all(spark, d):
    return output.flatten(output.tag_groups(migrated(spark, d), GROUPS)).select("record_key", F.col("group").alias("tags"))


@register(f"{_HITS} SELECT record_key, CASE WHEN a THEN 'round' WHEN b THEN 'cheap' WHEN c THEN 'blue' END AS tag FROM h")
def groups_first(spark, d):
    return output.tag_groups(migrated(spark, d), GROUPS, "first_match").select("record_key", F.col("group").alias("tag"))


_MERGED = [{"field": "record_key"}, {"field": "dest_id"}, {"field": "match_step", "header": "step"}, {"field": "derived_id"}]


@register(f"""{_CASCADE} SELECT record_key, dest_id, CASE t WHEN 0 THEN 'raw' ELSE 'cleaned' END AS step, supplier_id AS derived_id, false AS is_unmatched FROM best
  UNION ALL SELECT record_key, NULL, 'unmatched', NULL, true FROM migrated WHERE record_key NOT IN (SELECT record_key FROM best)""")
def merged_view(spark, d):
    return pipeline.merged(cascade(spark, d, columns={"matched": _MERGED}))


@register(f"{_CASCADE} SELECT record_key AS \"Record\", dest_name AS \"Name\" FROM best")
def column_mapping(spark, d):
    cols = {"columns": {"matched": [{"field": "record_key", "header": "Record"}, {"fields": ["absent", "dest_name"], "header": "Name"}]}}
    return output.map_columns(cascade(spark, d).matched, cols)


@register(f"{WITH} SELECT record_key, coalesce(name, family) AS shown FROM migrated")
def variant_coalesce(spark, d):
    cols = {"columns": {"matched": [{"field": "record_key"}, {"fields": ["name", "family"], "header": "shown"}]}}
    return output.map_columns(migrated(spark, d), cols, coalesce=True)


@register(f"{_CASCADE} SELECT CASE t WHEN 0 THEN 'raw' ELSE 'cleaned' END AS match_step, count(*) AS n FROM best GROUP BY t")
def step_counts(spark, d):
    return cascade(spark, d).matched.groupBy("match_step").agg(F.count("*").alias("n"))
