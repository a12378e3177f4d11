import pytest
from pyspark.sql import functions as F

from matchloom.operators import output, resolve
from matchloom.operators.joins import POS, TieBreaker


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sides(spark):
    src = spark.createDataFrame([("v1", "Acme", "1 main st", 0), ("v2", "Acme", "9 oak ave", 1), ("v3", "Beta", "2 elm rd", 2), ("v4", "None", None, 3), (None, "Acme", "1 main st", 4)], f"id string, name string, addr string, {POS} long")
    dst = spark.createDataFrame([("d1", "Acme", "1 main st", "S2", 0), ("d2", "Acme", "9 oak ave", "S1", 1), ("d3", "Beta", "far away", "S9", 2)], f"did string, dname string, daddr string, sid string, {POS} long")
    return src, dst


STEP = {"name": "one", "source": "s", "destination": "d", "match_fields": [{"source": "name", "destination": "dname", "method": "exact", "tiers": ["raw"]}], "address_support": {"source": ["addr"], "destination": ["daddr"], "threshold": 80}, "inherit": [{"source": "sid", "as": "derived"}]}


def test_gates_and_reasons(sides):
    src, dst = sides
    r = resolve.run_steps([STEP], {"s": src, "d": dst}, {}, resolve.Norm(), "id")
    best = resolve.best(r.matched, "id")
    assert rows(best.where("id is not null"), "id", "did", "derived", "match_step") == [("v1", "d1", "S2", "one")], "one candidate is kept before the gate"
    missed = resolve.unmatched(src, best, "id", r.rejected)
    assert rows(missed, "id", "reason_code", "rejection_step") == [("v2", "addr_below_threshold", "one"), ("v3", "addr_below_threshold", "one"), ("v4", "no_name_match", None)]
    assert all(x["best_rejected_score"] is not None for x in missed.where("id in ('v2', 'v3')").collect())


def test_street_goes_before_the_threshold(sides):
    src, dst = sides
    spec = STEP | {"address_support": STEP["address_support"] | {"require_street_match": True}}
    r = resolve.run_steps([spec], {"s": src, "d": dst}, {}, resolve.Norm(), "id")
    assert rows(r.rejected.where("__rk is not null"), "__rk", "reason") == [("v2", "street_mismatch"), ("v3", "street_mismatch")]


def test_all_candidates_pass_the_gate_in_all_matches(sides):
    src, dst = sides
    r = resolve.run_steps([STEP], {"s": src, "d": dst}, {}, resolve.Norm(), "id", mode="all_matches")
    assert rows(resolve.best(r.matched, "id", "all_matches").where("id is not null"), "id", "did") == [("v1", "d1"), ("v2", "d2")]


def test_earlier_steps_win_then_scores_then_ties(sides):
    src, dst = sides
    plain = {k: v for k, v in STEP.items() if k != "address_support"}
    fuzzy = plain | {"name": "two", "match_fields": [{"source": "name", "destination": "dname", "method": "fuzzy", "threshold": 40, "tiers": ["raw"]}]}
    r = resolve.run_steps([plain, fuzzy], {"s": src, "d": dst}, {}, resolve.Norm(), "id")
    best = resolve.best(r.matched, "id", tie=TieBreaker("sid", "alpha"))
    by = {x["id"]: x for x in best.collect()}
    assert by["v1"]["match_step"] == "one" and by["v1"]["name_score"] == 100.0
    assert "two" not in {x["match_step"] for k, x in by.items() if k in ("v1", "v2", "v3")}
    back = resolve.run_steps([fuzzy, plain], {"s": src, "d": dst}, {}, resolve.Norm(), "id")
    assert {x["match_step"] for x in resolve.best(back.matched, "id").where("id in ('v1', 'v2', 'v3')").collect()} == {"two"}


def test_exclusions_let_records_fall_through(sides):
    src, dst = sides
    plain = {k: v for k, v in STEP.items() if k != "address_support"}
    first = plain | {"exclude": {"values": ["v1"]}}
    r = resolve.run_steps([first, plain | {"name": "two"}], {"s": src, "d": dst}, {}, resolve.Norm(), "id")
    assert dict(rows(resolve.best(r.matched, "id").where("id is not null"), "id", "match_step")) == {"v1": "two", "v2": "one", "v3": "one"}
    assert r.exclusions["one"]["values"] == ["v1"]


def test_rollup(spark):
    m = spark.createDataFrame(
        [("a", "Fam", "S30", "x"), ("b", "fam.", "S4", "x"), ("c", None, "S1", "x"), ("d", " ", "S2", "x"), ("e", "Fam", "S0", "other"), ("f", "solo", "bad", "x")], "id string, fam string, target string, match_step string"
    )
    got = resolve.rollup(m, [{"steps": ["x"], "group_key": "fam", "group_key_tier": "clean", "target": "target", "strip_prefix": "alpha", "write_to": "r"}])
    assert rows(got, "id", "r", "r_changed") == [("a", "S4", True), ("b", "S4", False), ("c", "S1", False), ("d", "S2", False), ("e", "S0", False), ("f", "bad", False)]
    every = resolve.rollup(m, [{"group_key": "fam", "target": "target", "strip_prefix": "alpha", "order": "desc"}], step_names=["x", "other"])
    assert dict(rows(every, "id", "rolled_supplier_id"))["e"] == "S30"


def test_enrich_and_order(spark):
    src = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("a", 4)], "id string, n int").withColumn(POS, F.col("n").cast("long"))
    m = spark.createDataFrame([("a", "x", 5), ("a", "y", 6), ("z", "w", 7)], f"id string, extra string, {POS} long")
    assert rows(resolve.enrich(src, m, "id"), "id", "n", "extra") == [("a", 2, "x"), ("a", 4, "x"), ("b", 1, None), ("c", 3, None)]
    with pytest.raises(ValueError, match="no column k"):
        resolve.enrich(src, m, "k")
    assert [r["id"] for r in resolve.source_order(m, src, "id").collect()] == ["a", "a", "z"]


DATA = [("1", "S2.50", "2.5", None), ("2", "9.5", "12-34", "x"), ("3", "AB", "1", "y"), ("4", " ", "7", "z"), ("5", "1d", "2", None), ("6", "B10", "A9", None)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(DATA, "id string, l string, r string, o string")


def test_compare(data):
    got = output.compare(data, {"left": "l", "right": "r", "output": "v"})
    assert dict(rows(got, "id", "v")) == {"1": "same", "2": "higher", "3": "lower", "4": None, "5": "lower", "6": "higher"}
    assert dict(rows(output.compare(data, {"left": "l", "right": "r", "output": "v", "strip_prefix": "none"}), "id", "v"))["6"] == "higher"


def test_decisions(data):
    first = output.decision_record(data, {"candidates": ["o", "l", "r", "absent"], "write_to": "w"})
    assert rows(first, "id", "w", "w_src")[:4] == [("1", "S2.50", "l"), ("2", "x", "o"), ("3", "y", "o"), ("4", "z", "o")]
    low = output.decision_record(data, {"candidates": ["l", "r"], "write_to": "w", "select": "min"})
    assert dict((i, (w, s)) for i, w, s in rows(low, "id", "w", "w_src")) == {"1": ("S2.50", "l"), "2": ("9.5", "l"), "3": ("1", "r"), "4": ("7", "r"), "5": ("2", "r"), "6": ("A9", "r")}


GROUPS = [{"group_name": "g2", "regex": "^9", "match_columns": ["l", "absent"]}, {"group_name": "g1", "values": [" X ", "7"], "match_columns": ["o", "r"], "exclude_regex": "^z"}]


def test_groups(data):
    tagged = output.tag_groups(data, GROUPS)
    assert dict((i, tuple(g)) for i, g in rows(tagged, "id", "group")) == {"1": (), "2": ("g1", "g2"), "3": (), "4": (), "5": (), "6": ()}
    assert dict(rows(output.tag_groups(data, GROUPS, "first_match"), "id", "group"))["2"] == "g2"
    assert dict(rows(output.flatten(tagged), "id", "group"))["2"] == "g1;g2"


def test_computed_columns_are_pruned(data):
    cfg = {"decision_record": {"candidates": ["l", "r"], "write_to": "w"}, "compare_columns": [{"left": "l", "right": "r", "output": "v"}], "columns": {"matched": [{"field": "v"}]}}
    assert output.compute(data, cfg).columns == [*data.columns, "v"]


def test_merged_view(data):
    m = data.where("id < '3'").withColumn("match_step", F.lit("s")).withColumn("derived", F.col("id").cast("int"))
    got = output.merged_view(m, data.where("id >= '5'").withColumn("derived", F.lit("source value")), ["derived"])
    assert rows(got, "id", "match_step", "derived", "is_unmatched") == [("1", "s", 1, False), ("2", "s", 2, False), ("5", "unmatched", None, True), ("6", "unmatched", None, True)]
