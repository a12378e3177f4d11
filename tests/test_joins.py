import pytest

from matchloom.functions import similarity
from matchloom.functions.text import tier_value as text_of
from matchloom.operators import joins
from matchloom.operators.joins import POS, Norm, TieBreaker

SRC = [("v1", "Acme Inc", 0), ("v2", "ACME, INC.", 1), ("v3", None, 2), ("v4", "", 3), ("v5", "Zeta", 4), ("v6", "Beta-Gamma", 5), ("v1", "acme inc", 6)]
DST = [("d1", "acme inc", "S1000", 0), ("d2", "Acme Inc", "S500", 1), ("d3", "acme inc", "UNKNOWN", 2), ("d4", None, None, 3), ("d5", ".", "S1", 4), ("d6", "beta gamma", "S2", 5)]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(SRC, f"id string, name string, {POS} long"), spark.createDataFrame(DST, f"did string, name string, sid string, {POS} long")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_first_tier_that_matches_and_first_destination(sides):
    r = joins.exact(*sides, "name", "name", key="id")
    assert got(r, "id", "did", "match_tier") == [("v1", "d1", "raw"), ("v2", "d1", "clean"), ("v4", "d5", "clean"), ("v6", "d6", "clean")]
    assert "name_dst" in r.columns


def test_every_match_of_the_first_tier(sides):
    r = joins.exact(*sides, "name", "name", key="id", mode="all_matches")
    assert got(r, "id", "did", "match_tier") == [("v1", "d1", "raw"), ("v1", "d2", "raw"), ("v1", "d3", "raw"), *(("v2", d, "clean") for d in ("d1", "d2", "d3")), ("v4", "d5", "clean"), ("v6", "d6", "clean")]


@pytest.mark.parametrize(("order", "want"), [("asc", "d2"), ("desc", "d3")])
def test_tie_breaker(sides, order, want):
    r = joins.exact(*sides, "name", "name", ("clean",), key="id", tie=TieBreaker("sid", "alpha", order))
    assert dict(got(r, "id", "did"))["v2"] == want, "an id that doesn't parse goes last, and so first when descending"


def test_shuffled_input_gives_equal_results(sides):
    src, dst = sides
    want = got(joins.exact(src, dst, "name", "name", key="id"), "id", "did")
    for n in (1, 3, 7):
        assert got(joins.exact(src.repartition(n), dst.repartition(n), "name", "name", key="id"), "id", "did") == want


def test_self_matches_are_left_out(spark):
    df = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("c", "y", 2)], f"id string, name string, {POS} long")
    assert got(joins.exact(df, df, "name", "name", key="id", exclude_self="id"), "id", "id_dst") == [("a", "b"), ("b", "a")]
    assert got(joins.fuzzy(df, df, "name", "name", ("raw",), 80, "ratio", key="id", exclude_self="id"), "id", "id_dst") == [("a", "b"), ("b", "a")]


@pytest.mark.parametrize("method", ["exact", "fuzzy"])
@pytest.mark.parametrize("own", [None, "id"])
def test_a_hot_key_on_both_sides_never_meets_itself_in_full(spark, method, own):
    """A third of all rows share a key on both sides (and as many have none): as pairs they would be 10^8."""
    n = 30_000
    df = spark.range(n).selectExpr("cast(id as string) AS id", f"case id % 3 when 0 then 'hot key' when 1 then null else concat('k', id) end AS name", f"id AS {POS}")
    f = joins.exact if method == "exact" else lambda *a, **k: joins.fuzzy(df.where("name = 'hot key'"), df.where("name = 'hot key'"), *a[2:], ("raw",), 90, "ratio", **k)
    r = f(df, df, "name", "name", key="id", exclude_self=own)
    hot = r.where("name = 'hot key'").selectExpr("count(*) n", "count(distinct id_dst) d", "min(cast(id_dst as int)) lo", "max(cast(id_dst as int)) hi").first()
    assert (hot["n"], hot["d"], hot["lo"], hot["hi"]) == (n // 3, 2 if own else 1, 0, 3 if own else 0)


def test_first_rows_are_picked_before_the_shuffle(sides):
    plan = joins.exact(*sides, "name", "name", key="id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_suffixes():
    assert joins.renamed(["a", "b"], ["a", "c"]) == {"a": "a_dst", "c": "c"}
    assert joins.renamed(["a", "a_dst"], ["a"]) == {"a": "a_dst2"}
    assert joins.renamed(["a", "a_dst", "a_dst2"], ["a", "z"]) == {"a": "a_dst3", "z": "z"}


def brute(scorer, threshold, left, right):
    out = []
    for key, a, _ in left:
        best = None
        for d, b, *_ in right:
            x = similarity.scorer(scorer)(a or "", b or "")
            if x >= threshold and (best is None or x > best[1]):
                best = (d, x)
        if best:
            out.append((key, best[0], round(best[1], 3)))
    return sorted(out)


NAMES = ["alpha beta", "beta alpha", "alpha betta", "gamma", "delta epsilon zeta", "delta zeta epsilon", "gama", "", "al", "a" * 70, "a" * 69 + "b", "éta théta"]


@pytest.mark.parametrize("few", [0, 20_000])
@pytest.mark.parametrize("scorer", [*similarity.SCORERS, "unknown"])
@pytest.mark.parametrize("threshold", [0, 60, 85])
def test_fuzzy_equals_brute_force(spark, scorer, threshold, few, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_KEYS", few)
    left = [(f"v{i}", n, i) for i, n in enumerate([*NAMES[::-1], None])]
    right = [(f"d{i}", n, i) for i, n in enumerate([*NAMES, "alpha  beta"])]
    src, dst = spark.createDataFrame(left, f"id string, name string, {POS} long"), spark.createDataFrame(right, f"did string, target string, {POS} long")
    r = joins.fuzzy(src, dst, "name", "target", ("raw",), threshold, scorer, key="id")
    assert [(a, b, round(c, 3)) for a, b, c in got(r, "id", "did", "name_score")] == brute(scorer, threshold, left, right)


def test_fuzzy_all_matches_and_tiers(sides):
    r = joins.fuzzy(*sides, "name", "name", threshold=90, key="id", mode="all_matches", norm=Norm())
    assert ("v2", "d1", "clean") in got(r, "id", "did", "match_tier") and ("v1", "d2", "raw") in got(r, "id", "did", "match_tier")
    assert {r for r in got(r, "id", "did") if r[0] == "v4"} == {("v4", "d4")}, "null counts as empty"


@pytest.mark.parametrize("few", [0, 20_000])
def test_blocks_split_large_lengths(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "BLOCK", 3)
    monkeypatch.setattr(joins, "BROADCAST_KEYS", few)
    names = [f"name{i:03d}" for i in range(40)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "k string, pos long")
    found = {(r["a"], r["b"]) for r in joins.score_keys(df.select("k"), df, "ratio", 85).collect()}
    assert found == {(a, b) for a in names for b in names if similarity.ratio(a, b) >= 85}


def test_keys_of_few_words_meet_in_blocks_and_keys_of_rare_words_by_the_index(spark, monkeypatch):
    """Candidates of frequent words would be rows of nearly all pairs; either way finds what brute force finds."""
    words = ["red", "old", "big", "hot", "ring", "bolt", "rod", "plate"]
    common = [f"{a} {b} brand {n}" for a in words[:4] for b in words[4:] for n in range(20)]
    rare = [f"{a} {b} w{n * 7919 % 1_000_003:06d} x{n * 104_729 % 1_000_003:06d}" for n, (a, b) in enumerate((a, b) for a in words[:4] for b in words[4:] for _ in range(20))]
    monkeypatch.setattr(joins, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(joins, "BLOCK", 64)
    for keys, few in ((common, False), (rare, True)):
        left, right = [f"{k} ltd" for k in keys[::4]], keys + [f"{k} retired {i}" for i, k in enumerate(keys)]
        a = spark.createDataFrame([(k,) for k in left], "k string")
        b = spark.createDataFrame([(k, i) for i, k in enumerate(right)], "k string, pos long")
        monkeypatch.setattr(joins, "PAIRS_A_CANDIDATE", 15)
        assert joins._few_candidates(a, b, 88) == few
        with monkeypatch.context() as m:
            if not few:
                m.setattr(joins, "_shared_tokens", lambda *_: pytest.fail("pairs as rows"))
            found = {(r["a"], r["b"]): r["score"] for r in joins.score_keys(a, b, "token_set_ratio", 88).collect()}
        want = {(x, y): s for x in left for y in right if (s := similarity.token_set_ratio(x, y)) >= 88}
        assert found == pytest.approx(want, abs=1e-3) and len(want) > 50


def _all_of_first_tier(src, dst, own):
    """By rows: every match of the first tier in which some row of the key has one."""
    forms = lambda x: (x, text_of("clean", x, None, None)) if x is not None else (None, None)
    hits = [(key, t, did, pos) for key, name, rec, pos in src for did, other, drec in dst for t in (0, 1) if forms(name)[t] is not None and forms(name)[t] == forms(other)[t] and (not own or None not in (rec, drec) and rec != drec)]
    first = {}
    for key, t, *_ in hits:
        first[key] = min(t, first.get(key, t))
    return sorted((str(key), did, pos) for key, t, did, pos in hits if t == first[key])


@pytest.mark.parametrize("own", [None, "rec"])
@pytest.mark.parametrize("join", ["exact", "fuzzy"])
def test_the_first_tier_is_found_before_destinations_are_joined(spark, join, own):
    names = ["Acme Inc", "acme inc", "ACME, INC.", None, "", "Beta-Gamma", "beta gamma", "Zeta"]
    src = [(None if i % 7 == 0 else f"v{i % 9}", names[i % 8], None if i % 5 == 0 else f"r{i % 4}", i) for i in range(40)]
    dst = [(f"d{i}", names[(3 * i) % 8], None if i % 6 == 0 else f"r{i % 3}") for i in range(30)]
    if join == "fuzzy":  # in which null names are empty
        src, dst = [(k, n or "", r, i) for k, n, r, i in src], [(d, n or "", r) for d, n, r in dst]
    a = spark.createDataFrame(src, f"id string, name string, rec string, {POS} long")
    b = spark.createDataFrame([(*x, i) for i, x in enumerate(dst)], f"did string, name string, rec string, {POS} long")
    more = {"exclude_self": own} if own else {}
    made = joins.exact(a, b, "name", "name", key="id", mode="all_matches", **more) if join == "exact" else joins.fuzzy(a, b, "name", "name", threshold=100, key="id", mode="all_matches", **more)
    want = _all_of_first_tier(src, dst, own)
    assert sorted((str(r["id"]), r["did"], r[POS]) for r in made.collect()) == want and len(want) > 50
    lines = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    top = next(i for i, x in enumerate(lines) if "Join" in x)
    at = lines[top].index("Join")
    right = next(i for i, x in enumerate(lines) if i > top and x[at : at + 3] == "+- ")
    assert not any("Join" in x for x in lines[right:]), "matches are joined with no aggregate of matches"
