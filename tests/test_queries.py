import pytest

from matchloom import queries
from matchloom.queries import base

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    compare(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def test_only_two_queries_have_no_oracle():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"fuzzy_token_set_whole_tables", "fuzzy_whole_tables"}


@pytest.mark.parametrize("few", [True, False])
def test_token_sets_of_whole_tables_equal_brute_force(spark, monkeypatch, few):
    """By way of few destinations, and by way of blocks and the index of tokens, where few pairs are held against each other."""
    from matchloom.functions import similarity
    from matchloom.operators import joins

    if not few:
        monkeypatch.setattr(joins, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(joins, "BLOCK", 8)
    src = {r["name"] or "" for r in base.migrated(spark, SF).collect()}
    dst = {r["dest_name"] for r in base.trusted(spark, SF).collect()}
    want = {(a, b): x for a in src for b in dst if (x := similarity.token_set_ratio(a, b)) >= 88}
    got = [tuple(r) for r in queries.QUERIES["fuzzy_token_set_whole_tables"](spark, SF).collect()]
    assert len(got) == len(want) > 100 and {(a, b): s for a, b, s in got} == pytest.approx(want, abs=1e-3)
    if not few:
        a, b = (spark.createDataFrame([(x,) for x in side], "k string") for side in (src, dst))
        assert joins._shared_tokens(a, b, 88).count() < 0.05 * len(src) * len(dst)


def test_fuzzy_join_of_whole_tables_equals_brute_force(spark, monkeypatch):
    """All pairs, over all rows of the smallest tables, by way of few destinations and by way of blocks."""
    from matchloom.functions.similarity import token_sort_ratio
    from matchloom.functions.text import tier_value
    from matchloom.operators import joins

    clean = lambda x: tier_value("clean", x, None, None) or ""
    src = [(r["record_key"], clean(r["name"])) for r in base.migrated(spark, SF).collect()]
    dst = [(r[joins.POS], r["dest_id"], clean(r["dest_name"])) for r in base.trusted(spark, SF).orderBy(joins.POS).collect()]
    known, want = {}, {}
    for key, a in src:
        if a not in known:
            scored = [(token_sort_ratio(a, b), -pos, d) for pos, d, b in dst]
            known[a] = max(scored)
        score, _, d = known[a]
        if score >= 92:
            want[key, d] = score
    for few in (joins.BROADCAST_KEYS, 0):
        monkeypatch.setattr(joins, "BROADCAST_KEYS", few)
        got = {(r["record_key"], r["dest_id"]): r["score"] for r in queries.QUERIES["fuzzy_whole_tables"](spark, SF).collect()}
        assert got == pytest.approx(want, abs=1e-3) and len(want) > 50


def test_plans_of_native_queries_have_no_python(spark):
    for name in ("exact_best", "cascade_best", "merged_view", "rollup_clean_key", "groups_all", "compare_columns", "profile_unicode", "profile_trigrams"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["filter_dsl_and"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment)" in plan and "c_acctbal" not in plan
