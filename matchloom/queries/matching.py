"""Exact and fuzzy joins, addresses, cascades, rollups, phases and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address, similarity
from ..operators import resolve
from ..operators.joins import POS, Norm, TieBreaker, exact, fuzzy, score_keys
from ..plans import pipeline
from .base import WITH, Query, chars, clean_sql, migrated, ratio_sql, read, sorted_tokens, trusted

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_PAIRS = f"""{WITH}, keyed AS (SELECT *, name AS k0, {clean_sql('name')} AS k1 FROM migrated),
  dkeyed AS (SELECT *, dest_name AS d0, {clean_sql('dest_name')} AS d1, ltrim(supplier_id, 'S')::BIGINT AS tie FROM trusted),
  pairs AS (SELECT *, 0 AS t, 'raw' AS match_tier FROM keyed JOIN dkeyed ON k0 = d0 UNION ALL SELECT *, 1, 'clean' FROM keyed JOIN dkeyed ON k1 = d1)"""
_BEST = "SELECT record_key, dest_id, match_tier FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY t, {order}) AS n FROM pairs) WHERE n = 1"


@register(f"{_PAIRS} {_BEST.format(order='dest_ordinal')}")
def exact_best(spark, d):
    return exact(migrated(spark, d), trusted(spark, d), "name", "dest_name", key="record_key").select("record_key", "dest_id", "match_tier")


@register(f"{_PAIRS} SELECT record_key, dest_id, match_tier FROM (SELECT *, min(t) OVER (PARTITION BY record_key) AS b FROM pairs) WHERE t = b")
def exact_all(spark, d):
    return exact(migrated(spark, d), trusted(spark, d), "name", "dest_name", key="record_key", mode="all_matches").select("record_key", "dest_id", "match_tier")


@register(f"{_PAIRS} {_BEST.format(order='tie, dest_ordinal')}")
def exact_tiebreak_alpha(spark, d):
    tie = TieBreaker("supplier_id", "alpha")
    return exact(migrated(spark, d), trusted(spark, d), "name", "dest_name", key="record_key", tie=tie).select("record_key", "dest_id", "match_tier")


@register(f"{_PAIRS} {_BEST.format(order='tie DESC, dest_ordinal')}")
def exact_tiebreak_desc(spark, d):
    tie = TieBreaker("supplier_id", "alpha", "desc")
    return exact(migrated(spark, d), trusted(spark, d), "name", "dest_name", key="record_key", tie=tie).select("record_key", "dest_id", "match_tier")


@register("""SELECT a.p_partkey AS id, min(b.p_partkey) AS other FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey
  GROUP BY a.p_partkey""")
def exact_self(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_partkey").alias(POS))
    return exact(p, p, "name", "name", ("raw",), key="id", exclude_self="id").select("id", F.col("id_dst").alias("other"))


@register(f"""{WITH}, n AS (SELECT record_key, name, kind FROM migrated WHERE kind <> 'PROMO'), t AS (SELECT * FROM trusted WHERE starts_with(supplier_id, 'S10'))
  SELECT record_key, min(dest_id) AS dest_id FROM (SELECT record_key, first_value(dest_id) OVER (PARTITION BY record_key ORDER BY dest_ordinal) AS dest_id FROM n JOIN t ON {clean_sql('name')} = {clean_sql('dest_name')}) GROUP BY record_key""")
def step_filters_both(spark, d):
    spec = {
        "name": "s", "match_fields": [{"source": "name", "destination": "dest_name", "method": "exact", "tiers": ["clean"]}],
        "filters": [{"field": "kind", "op": "neq", "value": "PROMO", "applies_to": "source"}, {"field": "supplier_id", "op": "starts_with", "value": "S10"}],
    }
    return resolve.step(migrated(spark, d), trusted(spark, d), spec, key="record_key").matched.select("record_key", "dest_id")


def _names(spark, d, mangle):
    names = read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select(F.expr(mangle).alias("name"), F.hash("name").cast("long").alias(POS))


_MANGLE = "upper(substr(name, 1, 1)) || substr(name, 2) || 's'"
_SWAP = "split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1) || 's'"
_LIST = "names AS (SELECT DISTINCT p_name AS name FROM part)"


def _scores(mangle, key, least):
    return f"""WITH {_LIST}, x AS (SELECT a, b, {chars(key.format('a'))} AS ca, {chars(key.format('b'))} AS cb FROM (SELECT {mangle} AS a FROM names), (SELECT name AS b FROM names)),
      s AS (SELECT a, b, ({ratio_sql('ca', 'cb')})::FLOAT::DOUBLE AS raw_score FROM x), hits AS (SELECT a, b, round(raw_score, 4) AS score FROM s WHERE raw_score >= {least})"""


def _all(spark, d, mangle, scorer, least):
    a, b = (_names(spark, d, m).select(F.col("name").alias("k"), F.col(POS).alias("pos")) for m in (mangle, "name"))
    return score_keys(a.select("k"), b, scorer, least).select("a", "b", F.round("score", 4).alias("score"))


@register(f"{_scores(_MANGLE, '{}', 80)} SELECT * FROM hits")
def fuzzy_ratio_all(spark, d):
    return _all(spark, d, _MANGLE, "ratio", 80)


@register(f"{_scores(_SWAP, sorted_tokens('{}'), 85)} SELECT * FROM hits")
def fuzzy_token_sort_all(spark, d):
    return _all(spark, d, _SWAP, "token_sort_ratio", 85)


def _best(spark, d, mangle, scorer, least):
    # Names in the order of the alphabet, so that equal scores have one winner.
    a, b = (_names(spark, d, m).drop(POS).withColumn(POS, F.conv(F.hex(F.substring("name", 1, 7)), 16, 10).cast("long")) for m in (mangle, "name"))
    out = fuzzy(a, b.withColumnRenamed("name", "target"), "name", "target", ("raw",), least, scorer)
    return out.select(F.col("name").alias("a"), F.round("name_score", 4).alias("score"))


@register(f"{_scores(_MANGLE, '{}', 70)} SELECT a, max(score) AS score FROM hits GROUP BY a")
def fuzzy_ratio_best(spark, d):
    return _best(spark, d, _MANGLE, "ratio", 70)


@register(f"{_scores(_SWAP, sorted_tokens('{}'), 70)} SELECT a, max(score) AS score FROM hits GROUP BY a")
def fuzzy_token_sort_best(spark, d):
    return _best(spark, d, _SWAP, "token_sort_ratio", 70)


@register(f"""WITH {_LIST}, x AS (SELECT p.name AS a, q.name AS b, {chars('p.name')} AS ca, {chars('q.name')} AS cb FROM names p, names q WHERE p.name <> q.name),
  s AS (SELECT a, b, ({ratio_sql('ca', 'cb')})::FLOAT::DOUBLE AS score FROM x) SELECT a, round(max(score), 4) AS score FROM s WHERE score >= 75 GROUP BY a""")
def fuzzy_self(spark, d):
    n = _names(spark, d, "name")
    return fuzzy(n, n, "name", "name", ("raw",), 75, "ratio", exclude_self="name").select(F.col("name").alias("a"), F.round("name_score", 4).alias("score"))


_SETS = f"""WITH {_LIST}, p AS (SELECT p.name || ' ltd' AS a, q.name AS b FROM names p, names q), t AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM p),
  u AS (SELECT a, b, list_sort(list_intersect(x, y)) AS i, list_sort(list_filter(x, lambda v: NOT list_contains(y, v))) AS p, list_sort(list_filter(y, lambda v: NOT list_contains(x, v))) AS q FROM t),
  w AS (SELECT a, b, len(i) AS ni, len(p) AS np, len(q) AS nq, {chars("array_to_string(i, ' ')")} AS ci, {chars("array_to_string(list_concat(i, p), ' ')")} AS cp, {chars("array_to_string(list_concat(i, q), ' ')")} AS cq FROM u),
  s AS (SELECT a, b, CASE WHEN ni > 0 AND (np = 0 OR nq = 0) THEN 100.0 WHEN ni = 0 THEN {ratio_sql('cp', 'cq')} ELSE greatest({ratio_sql('cp', 'cq')}, {ratio_sql('ci', 'cp')}, {ratio_sql('ci', 'cq')}) END AS score FROM w)
  SELECT a, b, round(score, 4) AS score FROM s WHERE score >= 60"""


@register(_SETS)
def fuzzy_token_set(spark, d):
    return _all(spark, d, "name || ' ltd'", "token_set_ratio", 60)


@register(f"""WITH {_LIST}, p AS (SELECT substr(p.name, 3, 5) AS a, q.name AS b FROM names p, names q), x AS (SELECT DISTINCT a, b FROM p),
  w AS (SELECT a, b, unnest(range(1 - length(a), length(b)))::BIGINT AS i FROM x),
  v AS (SELECT DISTINCT a, b, substr(b, greatest(i, 0) + 1, CASE WHEN i < 0 THEN length(a) + i ELSE length(a) END) AS win FROM w),
  c AS (SELECT a, b, {chars('a')} AS ca, {chars('win')} AS cb FROM v), s AS (SELECT a, b, max({ratio_sql('ca', 'cb')}) AS score FROM c GROUP BY a, b)
  SELECT a, b, round(score::FLOAT::DOUBLE, 4) AS score FROM s WHERE score >= 80""")
def fuzzy_partial(spark, d):
    a = _names(spark, d, "substr(name, 3, 5)").select(F.col("name").alias("k")).distinct()
    b = _names(spark, d, "name").select(F.col("name").alias("k"), F.col(POS).alias("pos"))
    return score_keys(a, b, "partial_ratio", 80).select("a", "b", F.round("score", 4).alias("score"))


def _ordered(x, y):
    return f"CASE WHEN length({x}) <= length({y}) THEN {x} ELSE {y} END AS s, CASE WHEN length({x}) <= length({y}) THEN {y} ELSE {x} END AS l"


# Its parts, put together as they are weighted: partial scores of the keys, of their sorted tokens and of their sets of tokens.
_WRATIO = f"""WITH {_LIST}, p AS (SELECT p.name || ' limited company' AS a, q.name AS b FROM names p, names q),
  t AS (SELECT a, b, {sorted_tokens('a')} AS sa, {sorted_tokens('b')} AS sb, list_sort(list_distinct(string_split(a, ' '))) AS x, list_sort(list_distinct(string_split(b, ' '))) AS y FROM p),
  u AS (SELECT *, array_to_string(x, ' ') AS da, array_to_string(y, ' ') AS db, list_sort(list_intersect(x, y)) AS i, list_filter(x, lambda v: NOT list_contains(y, v)) AS l, list_filter(y, lambda v: NOT list_contains(x, v)) AS r FROM t),
  q AS (SELECT {_ordered('a', 'b')} FROM u UNION SELECT {_ordered('sa', 'sb')} FROM u UNION SELECT {_ordered('da', 'db')} FROM u),
  e AS (SELECT s, l, s AS pat, l AS txt FROM q UNION ALL SELECT s, l, l, s FROM q WHERE length(s) = length(l)),
  w AS (SELECT s, l, pat, txt, unnest(range(1 - length(pat), length(txt)))::BIGINT AS k FROM e),
  v AS (SELECT DISTINCT s, l, pat, substr(txt, greatest(k, 0) + 1, CASE WHEN k < 0 THEN length(pat) + k ELSE length(pat) END) AS win FROM w),
  c AS (SELECT s, l, {chars('pat')} AS ca, {chars('win')} AS cb FROM v), part AS (SELECT s, l, max({ratio_sql('ca', 'cb')}) AS score FROM c GROUP BY s, l),
  f AS (SELECT a, b, sa, sb, da, db, len(i) AS ni, len(l) AS nl, len(r) AS nr, {chars('a')} AS ca, {chars('b')} AS cb, {chars('sa')} AS csa, {chars('sb')} AS csb, {chars("array_to_string(i, ' ')")} AS ci,
    {chars("array_to_string(list_concat(i, l), ' ')")} AS cl, {chars("array_to_string(list_concat(i, r), ' ')")} AS cr, greatest(length(a), length(b)) / least(length(a), length(b)) AS apart FROM u),
  g AS (SELECT *, {ratio_sql('ca', 'cb')} AS base, CASE WHEN apart < 1.5 THEN {ratio_sql('csa', 'csb')} END AS by_sort,
    CASE WHEN apart >= 1.5 THEN NULL WHEN ni > 0 AND (nl = 0 OR nr = 0) THEN 100.0 WHEN ni = 0 THEN {ratio_sql('cl', 'cr')} ELSE greatest({ratio_sql('cl', 'cr')}, {ratio_sql('ci', 'cl')}, {ratio_sql('ci', 'cr')}) END AS by_set,
    CASE WHEN apart <= 8 THEN 0.9 ELSE 0.6 END AS scale FROM f),
  h AS (SELECT g.*, k1.score AS p1, CASE WHEN ni > 0 THEN 100.0 ELSE greatest(k2.score, k3.score) END AS p2 FROM g
    JOIN part k1 ON k1.s IN (a, b) AND k1.l IN (a, b) AND length(k1.s) + length(k1.l) = length(a) + length(b) AND (k1.s <> k1.l OR a = b)
    JOIN part k2 ON k2.s IN (sa, sb) AND k2.l IN (sa, sb) AND length(k2.s) + length(k2.l) = length(sa) + length(sb) AND (k2.s <> k2.l OR sa = sb)
    JOIN part k3 ON k3.s IN (da, db) AND k3.l IN (da, db) AND length(k3.s) + length(k3.l) = length(da) + length(db) AND (k3.s <> k3.l OR da = db)),
  z AS (SELECT a, b, CASE WHEN apart < 1.5 THEN greatest(base, 0.95::DOUBLE * greatest(by_sort, by_set)) ELSE greatest(base, scale::DOUBLE * p1, 0.95::DOUBLE * scale::DOUBLE * p2) END AS score FROM h)
  SELECT a, b, round(score::FLOAT::DOUBLE, 4) AS score FROM z WHERE score >= 80"""


@register(_WRATIO)
def fuzzy_wratio(spark, d):
    return _all(spark, d, "name || ' limited company'", "WRatio", 80)


@register(None)
def fuzzy_token_set_whole_tables(spark, d):
    """Every migrated name against every trusted one by sets of tokens, all hits; held against brute force like the next one."""
    a = migrated(spark, d).select(F.coalesce("name", F.lit("")).alias("k")).distinct()
    b = trusted(spark, d).groupBy(F.col("dest_name").alias("k")).agg(F.min(POS).alias("pos"))
    return score_keys(a, b, "token_set_ratio", 88).select("a", "b", F.round("score", 4).alias("score"))


@register(None)
def fuzzy_whole_tables(spark, d):
    """Every migrated name against every trusted one; too many pairs for SQL, so the tests hold it against brute force."""
    out = fuzzy(migrated(spark, d), trusted(spark, d), "name", "dest_name", ("clean",), 92, "token_sort_ratio", key="record_key")
    return out.select("record_key", "dest_id", F.round("name_score", 4).alias("score"))


@register(f"WITH {_LIST}, x AS (SELECT p.name AS a, q.name AS b, {chars('p.name')} AS ca, {chars('q.name')} AS cb FROM names p, names q) SELECT a, b, round({ratio_sql('ca', 'cb')}, 6) AS score FROM x WHERE a < b")
def scorer_udf(spark, d):
    similarity.register(spark)
    n = _names(spark, d, "name").select("name")
    n.createOrReplaceTempView("matchloom_names")
    return spark.sql("SELECT a.name AS a, b.name AS b, round(ratio(a.name, b.name), 6) AS score FROM matchloom_names a JOIN matchloom_names b ON a.name < b.name")


# Addresses of one grammar: number, street, "street" or "road", unit. Their street is what stands before the suffix.
_A, _B = "CAST(10 + p_size AS STRING) || ' ' || p_name || ' street suite 5'", "CAST(p_size AS STRING) || ' ' || p_name || ' street'"
_ADDRS = f"""WITH p AS (SELECT DISTINCT {_A} AS a, {_B} AS b, CAST(10 + p_size AS STRING) || ' ' || p_name AS sa, CAST(p_size AS STRING) || ' ' || p_name AS sb FROM part),
  c AS (SELECT a, b, {chars(sorted_tokens('a'))} AS ca, {chars(sorted_tokens('b'))} AS cb, {chars('sa')} AS da, {chars('sb')} AS db FROM p),
  s AS (SELECT a, b, {ratio_sql('ca', 'cb')} AS full_score, {ratio_sql('da', 'db')} AS street FROM c)"""


def _addresses(spark, d):
    p = read(spark, d, "part").selectExpr(f"{_A} AS a", f"{_B} AS b").distinct()
    return p.withColumn("x", address.score_columns([F.col("a")], [F.col("b")], tiers=["raw"]))


@register(f"{_ADDRS} SELECT a, b, round(street * 0.6 + full_score * 0.4, 6) AS score, street >= 80 AS street_match, 'addr1<>addr1' AS comparison FROM s")
def address_score(spark, d):
    return _addresses(spark, d).select("a", "b", F.round("x.score", 6).alias("score"), "x.street_match", "x.comparison")


_ADDR_STEP = {"name": "s", "match_fields": [{"source": "a_key", "destination": "b_key", "method": "exact", "tiers": ["raw"]}], "address_support": {"source": ["a"], "destination": ["b"], "tiers": ["raw"]}}


def _gated(spark, d, **gate):
    p = read(spark, d, "part").selectExpr(f"{_A} AS a", f"{_B} AS b").distinct().withColumn(POS, F.xxhash64("a"))
    src, dst = p.select("a", F.col("a").alias("a_key"), POS), p.select("b", F.col("a").alias("b_key"), POS)
    spec = {**_ADDR_STEP, "address_support": {**_ADDR_STEP["address_support"], **gate}}
    return resolve.step(src, dst, spec, key="a_key")


@register(f"{_ADDRS} SELECT a FROM s WHERE street >= 80")
def street_gate(spark, d):
    return _gated(spark, d, require_street_match=True).matched.select("a")


@register(f"{_ADDRS} SELECT a, 'addr_below_threshold' AS reason, round(street * 0.6 + full_score * 0.4, 6) AS best FROM s WHERE street * 0.6 + full_score * 0.4 < 88")
def address_threshold(spark, d):
    r = _gated(spark, d, threshold=88).rejected
    return r.select(F.col("__rk").alias("a"), "reason", F.round("best_addr_score", 6).alias("best"))


RECIPE = {
    "name": "cascade",
    "sources": {"migrated": {"file": "migrated"}, "trusted": {"file": "trusted"}},
    "populations": {"all": {"source": "migrated", "record_key": "record_key", "filter": []}},
    "steps": [
        {"name": "raw", "source": "all", "destination": "trusted", "match_fields": [{"source": "name", "destination": "dest_name", "method": "exact", "tiers": ["raw"]}], "inherit": [{"source": "supplier_id", "as": "derived_id"}]},
        {"name": "cleaned", "source": "all", "destination": "trusted", "match_fields": [{"source": "name", "destination": "dest_name", "method": "exact", "tiers": ["clean"]}], "inherit": [{"source": "supplier_id", "as": "derived_id"}]},
    ],
    "output": {"format": "csv", "tie_breaker": {"column": "dest_id", "strip_prefix": "alpha"}},
}
_CASCADE = f"""{_PAIRS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY t, dest_ordinal) AS n FROM pairs) WHERE n = 1)"""


def cascade(spark, d, write=False, **output):
    recipe = RECIPE | {"output": RECIPE["output"] | output}
    return pipeline.run(spark, recipe, sources={"migrated": migrated(spark, d), "trusted": trusted(spark, d)}, write=write)


@register(f"{_CASCADE} SELECT record_key, dest_id, supplier_id AS derived_id, CASE t WHEN 0 THEN 'raw' ELSE 'cleaned' END AS match_step FROM best")
def cascade_best(spark, d):
    return cascade(spark, d).matched.select("record_key", "dest_id", "derived_id", "match_step")


@register(f"{_CASCADE} SELECT record_key, 'no_name_match' AS reason_code FROM migrated WHERE record_key NOT IN (SELECT record_key FROM best)")
def cascade_unmatched(spark, d):
    return cascade(spark, d).unmatched.select("record_key", "reason_code")


@register(f"{_ADDRS} SELECT a, CASE WHEN street >= 80 THEN 'addr_below_threshold' ELSE 'street_mismatch' END AS reason_code, 'gate' AS rejection_step FROM s WHERE street < 80 OR street * 0.6 + full_score * 0.4 < 90")
def cascade_unmatched_reasons(spark, d):
    p = read(spark, d, "part").selectExpr(f"{_A} AS a", f"{_B} AS b").distinct().withColumn(POS, F.xxhash64("a"))
    src, dst = p.select("a", F.col("a").alias("a_key"), POS), p.select("b", F.col("a").alias("b_key"), POS)
    spec = {**_ADDR_STEP, "name": "gate", "source": "src", "destination": "dst", "address_support": {**_ADDR_STEP["address_support"], "threshold": 90, "require_street_match": True}}
    r = resolve.run_steps([spec], {"src": src, "dst": dst}, {}, Norm(), "a_key")
    missed = resolve.unmatched(src, resolve.best(r.matched, "a_key"), "a_key", r.rejected)
    return missed.select("a", "reason_code", "rejection_step")


@register(f"""{_CASCADE}, g AS (SELECT *, {clean_sql('family')} AS gk FROM best)
  SELECT record_key, supplier_id AS derived_id, first_value(supplier_id) OVER (PARTITION BY gk ORDER BY tie, supplier_id, ordinal) AS rolled,
    first_value(supplier_id) OVER (PARTITION BY gk ORDER BY tie, supplier_id, ordinal) <> supplier_id AS rolled_changed FROM g""")
def rollup_clean_key(spark, d):
    bucket = {"group_key": "family", "group_key_tier": "clean", "target": "derived_id", "strip_prefix": "alpha", "write_to": "rolled"}
    return cascade(spark, d, final_rollup=[bucket]).matched.select("record_key", "derived_id", "rolled", "rolled_changed")


@register(f"""{_CASCADE} SELECT record_key, CASE WHEN t = 1 THEN first_value(supplier_id) OVER (PARTITION BY t, family ORDER BY tie DESC, supplier_id, ordinal) ELSE supplier_id END AS rolled FROM best""")
def rollup_step_scope(spark, d):
    bucket = {"steps": ["cleaned"], "group_key": "family", "target": "derived_id", "strip_prefix": "alpha", "order": "desc", "write_to": "rolled"}
    return cascade(spark, d, final_rollup=[bucket]).matched.select("record_key", "rolled")


_STEP2 = {"method": "exact", "tiers": ["raw"]}


def _chain(spark, d, write=False):
    # Keys of a third of the customers and half of the nations are mangled, so that rows get lost in either phase.
    orders = read(spark, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS okey", "CAST(o_custkey AS STRING) AS cust", f"o_orderkey AS {POS}")
    customers = read(spark, d, "customer").selectExpr("CASE WHEN c_custkey % 3 = 0 THEN 'old ' ELSE '' END || CAST(c_custkey AS STRING) AS ckey", "CAST(c_nationkey AS STRING) AS nation", f"c_custkey AS {POS}")
    nations = read(spark, d, "nation").selectExpr("CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'old ' END || CAST(n_nationkey AS STRING) AS nkey", "n_name AS nation_name", f"CAST(n_nationkey AS BIGINT) AS {POS}")
    out = {"output": {"format": "csv"}}
    recipe = {
        "name": "chain", "sources": {n: {"file": n} for n in ("orders", "customers", "nations")},
        "phases": [
            {"name": "customers", "populations": {"o": {"source": "orders", "record_key": "okey"}}, "steps": [{"name": "to customer", "source": "o", "destination": "customers", "match_fields": [{"source": "cust", "destination": "ckey", **_STEP2}]}]},
            {"name": "nations", "populations": {"p": {"source": "_previous_matched", "record_key": "okey"}}, "steps": [{"name": "to nation", "source": "p", "destination": "nations", "match_fields": [{"source": "nation", "destination": "nkey", **_STEP2}]}]} | out,
        ],
    }
    return pipeline.run(spark, recipe, sources={"orders": orders, "customers": customers, "nations": nations}, write=write)


_CHAIN = """WITH o AS (SELECT o_orderkey::VARCHAR AS okey, o_custkey FROM orders), c AS (SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS c_custkey, c_nationkey FROM customer),
  n AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS n_nationkey, n_name FROM nation)"""


@register(f"{_CHAIN} SELECT okey, n_name AS nation_name FROM o JOIN c ON o_custkey = c_custkey LEFT JOIN n ON c_nationkey = n_nationkey")
def multi_phase_partial(spark, d):
    return _chain(spark, d).matched.select("okey", "nation_name")


@register(f"{_CHAIN} SELECT okey, n_name AS nation_name, 'to nation' AS match_step FROM o JOIN c ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey")
def multi_phase_chain(spark, d):
    return _chain(spark, d).phases[-1].matched.select("okey", "nation_name", "match_step")


@register(f"{_CHAIN} SELECT okey, 'no_name_match' AS reason_code FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c_custkey = o_custkey)")
def multi_phase_unmatched(spark, d):
    return _chain(spark, d).unmatched.select("okey", "reason_code")


@register("""SELECT c_custkey, c_name, o_orderkey AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def enrich_left(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"), F.col("o_orderkey").alias(POS))
    return resolve.enrich(c, o, "c_custkey")


def _counts(spark, stats):
    rows = [("total", stats["total_source"]), ("matched", stats["matched_count"]), ("unmatched", stats["unmatched_count"]), *((f"step {k}", n) for k, n in stats["step_counts"].items())]
    for p in stats.get("phases", []):
        rows += [(f"{p['name']}: input", p["input_count"]), (f"{p['name']}: matched", p["matched_count"]), *((f"{p['name']}: step {k}", n) for k, n in p["step_counts"].items())]
    return spark.createDataFrame(rows, "what string, n long")


@register(f"""{_CASCADE} SELECT 'total' AS what, count(*) AS n FROM migrated UNION ALL SELECT 'matched', count(*) FROM best UNION ALL SELECT 'step ' || CASE t WHEN 0 THEN 'raw' ELSE 'cleaned' END, count(*) FROM best GROUP BY t
  UNION ALL SELECT 'unmatched', count(*) FROM migrated WHERE record_key NOT IN (SELECT record_key FROM best)""")
def run_counts(spark, d):
    """Counts of a run, observed while its result was written once."""
    return _counts(spark, cascade(spark, d, write=True).stats())


@register(f"""{_CHAIN}, m AS (SELECT okey, n_nationkey FROM o JOIN c ON o_custkey = c_custkey LEFT JOIN n ON c_nationkey = n_nationkey), k AS (SELECT count(*) AS a, count(n_nationkey) AS b, (SELECT count(*) FROM o) AS t FROM m)
  SELECT unnest(['total', 'matched', 'unmatched', 'step to customer', 'step to nation', 'customers: input', 'customers: matched', 'customers: step to customer', 'nations: input', 'nations: matched', 'nations: step to nation']) AS what,
    unnest([t, a, t - a, a - b, b, t, a, a, a, b, b]) AS n FROM k""")
def run_counts_phases(spark, d):
    return _counts(spark, _chain(spark, d, write=True).stats())
