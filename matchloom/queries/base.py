"""Two sides to match, made from the driver's tables by expressions that Spark and DuckDB both read.

Both hold every part: ``migrated`` with a mangled name, ``trusted`` with the true name or, for two thirds, one that nothing has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import POS

Query = Callable[[SparkSession, str], DataFrame]

_FULL = "p_name || ' ' || replace(p_brand, '#', ' ') || ' ' || lower(p_type)"
_ADDR = "CAST(10 + p_size AS STRING) || ' ' || split_part(p_name, ' ', 1) || ' street suite ' || CAST(p_partkey % 9 AS STRING)"

MIGRATED = {
    "record_key": "'V' || CAST(p_partkey AS STRING)",
    "name": f"""CASE p_partkey % 7 WHEN 0 THEN upper({_FULL}) WHEN 1 THEN {_FULL} || ',' WHEN 2 THEN replace({_FULL}, ' ', '-')
      WHEN 3 THEN '  ' || replace({_FULL}, ' ', '  ') WHEN 4 THEN {_FULL} || ' Inc.' WHEN 5 THEN CAST(NULL AS STRING) ELSE {_FULL} END""",
    "addr1": _ADDR,
    "family": "p_name",
    "kind": "p_type",
    "parent_id": "'P' || CAST(p_size AS STRING)",
    "amount": "CAST(p_size AS STRING)",
    "ordinal": "p_partkey",
}
TRUSTED = {
    "dest_id": "'S' || CAST(1000 + p_partkey AS STRING)",
    "dest_name": f"CASE WHEN p_partkey % 3 = 0 THEN {_FULL} ELSE {_FULL} || ' retired ' || CAST(p_partkey AS STRING) END",
    "dest_addr": f"CASE WHEN p_partkey % 2 = 0 THEN {_ADDR} ELSE CAST(p_size AS STRING) || ' ' || p_brand || ' road' END",
    "supplier_id": "'S' || CAST(900 + p_partkey % 200 AS STRING)",
    "limit_amount": "CAST(p_partkey % 40 AS STRING)",
    "dest_ordinal": "p_partkey",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.selectExpr(*[f"{e} AS {n}" for n, e in MIGRATED.items()], f"p_partkey AS {POS}")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.selectExpr(*[f"{e} AS {n}" for n, e in TRUSTED.items()], f"p_partkey AS {POS}")


WITH = (
    "WITH migrated AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in MIGRATED.items()) + " FROM part), "
    "trusted AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in TRUSTED.items()) + " FROM part)"
)


def clean_sql(x: str) -> str:
    return rf"trim(regexp_replace(replace(regexp_replace(lower(trim({x})), '[,.;:]+', '', 'g'), '-', ' '), '\s+', ' ', 'g'))"


def normalized_sql(x: str, aliases: dict[str, str], stopwords: list[str]) -> str:
    out = clean_sql(x)
    for a, b in aliases.items():
        out = rf"regexp_replace({out}, '\b{a}\b', '{b}', 'g')"
    listed = ", ".join(f"'{s}'" for s in stopwords)
    return rf"trim(regexp_replace(array_to_string(list_filter(string_split({out}, ' '), lambda t: t NOT IN ({listed})), ' '), '\s+', ' ', 'g'))"


def lcs_sql(a: str, b: str) -> str:
    """The longest common subsequence of two lists of characters, row by row."""
    cells = f"list_prepend([0::BIGINT], list_transform(range(1, len({b}) + 1), lambda k: [k]))"
    row = f"list_reduce({cells}, lambda acc, j: list_append(acc, CASE WHEN {a}[i[1]] = {b}[j[1]] THEN row[j[1]] + 1 ELSE greatest(acc[j[1]], row[j[1] + 1]) END))"
    start = f"list_transform(range(0, len({b}) + 1), lambda k: 0::BIGINT)"
    return f"list_reduce(list_prepend({start}, list_transform(range(1, len({a}) + 1), lambda k: [k])), lambda row, i: {row})[-1]"


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 100.0 ELSE 200.0 * {lcs_sql(a, b)} / (len({a}) + len({b})) END"


def chars(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '') END"


def sorted_tokens(x: str) -> str:
    return rf"array_to_string(list_sort(list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')), ' ')"
