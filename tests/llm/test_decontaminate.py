import hashlib

import pytest

from matchloom.llm import decontaminate, registry

from .conftest import SF, terms


def brute(rows, items, size=10, slack=5):
    wins = [(str(k), w) for k, t in items if (x := terms(t)) for w in {tuple(x[i : i + size]) for i in range(max(1, len(x) - size + 1))}]
    out = []
    for key, text in rows:
        w, hit, ids, near = terms(text), set(), set(), set()
        have = set(w)
        for item, win in wins:
            if not have.issuperset(win):
                continue
            span = len(win) + slack
            if any(set(w[s : s + span]).issuperset(win) for s in range(len(w))):
                near.add(item)
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    ids.add(item)
        out.append((str(key), len(w), len(hit), sorted(ids), len(near)))
    return sorted(out)


def got(df, items):
    r = decontaminate.report(df, items)
    return sorted((str(x["id"]), x["n_words"], x["n_hit"], x["item_ids"], x["n_near_items"]) for x in r.collect())


ITEMS = [
    (1, "alpha beta gamma"), (2, "one two three four five six seven eight nine ten eleven twelve"), (2, "repeated id with other words"), (3, None), (4, " .,; "),
    (5, "word100 word101 word102 word103 word104 word105 word106 word107 word108 word109 word110"), (6, "and again and again and again and again and again"), (7, "zzz unknown words"), (8, "Ünïcode ÉÀ"),
]


def test_equals_brute_force(spark, docs, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    short = {k: t for k, t in texts.items() if len(t or "") < 6000}
    assert got(docs.where("length(text) < 6000 or text is null"), items) == brute(short.items(), pairs)


def test_edge_cases(spark, edge):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    extra = [(50, "x ALPHA, beta; gamma alpha beta gamma y", "s", 1, True), (51, "one two three four five six seven eight nine ten eleven", "s", 1, True), (52, "one two three four five six seven eight nine", "s", 1, True), (53, "gamma x x beta x alpha", "s", 1, True)]
    df = edge.union(spark.createDataFrame(extra, edge.schema))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(rows, ITEMS)
    assert got(df, items) == want
    assert any(n == 11 for _, _, n, *_ in want) and any("8" in i for *_, i, _ in want)
    assert any(near > len(i) for *_, i, near in want)
    kept = decontaminate.clean(df, items)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(k for k, _, n, *_ in want if not n)


def test_empty_tables(spark, edge, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(empty, items) == []
    assert all(n == near == 0 for _, _, n, _, near in got(edge, items.limit(0)))


def test_other_way_beyond_the_broadcast_bound(spark, edge, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = got(edge, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert got(edge, items) == want


def test_query_hashes_its_items(spark):
    rows = registry.op1_decontamination(spark, SF).collect()
    clean = next(r for r in rows if not r["contaminated"])
    assert clean["items_sha256"] == hashlib.sha256(b"").hexdigest() and clean["n_items"] == 0
    assert any(r["contaminated"] for r in rows)


def test_full_index_finds_the_same(spark, docs, edge):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    few, full = (decontaminate.build_index(edge, items, full=f) for f in (False, True))
    rows = lambda df: sorted(map(str, df.collect()))
    assert full.postings.count() == sum(len(terms(r["text"])) for r in edge.collect()) > few.postings.count()
    assert rows(decontaminate.occurrences(full)) == rows(decontaminate.occurrences(few)) != []
    assert rows(decontaminate.proximity_matches(full)) == rows(decontaminate.proximity_matches(few)) != []


def test_no_python_in_the_plans(spark, edge):
    files = spark.read.schema("item_id long, text string").parquet(SF + "/benchmark.parquet")
    index = decontaminate.build_index(edge, files)
    frames = [decontaminate.tokens(edge), decontaminate.item_words(files), decontaminate.candidates(index), decontaminate.near_candidates(index), decontaminate.occurrences(index)]
    for df in [*frames, decontaminate.proximity_matches(index), decontaminate.report(edge, files), decontaminate.clean(edge, files)]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("slack", [0, 3])
def test_proximity(spark, slack):
    docs = spark.createDataFrame([(1, "red big dog ran"), (2, "dog x red y big"), (3, "big dog"), (4, "dog a b c d e f g red h i j big"), (None, "x " * 1000 + "big z dog red")], "doc_id long, text string")
    index = decontaminate.build_index(docs, spark.createDataFrame([(9, "red big dog")], "item_id long, text string"))
    found = {r["id"] for r in decontaminate.proximity_matches(index, slack).collect()}
    assert found == ({1} if slack == 0 else {1, 2, None})


@pytest.mark.parametrize("cell", [256, 7])
def test_long_texts_of_repeated_words(spark, monkeypatch, cell):
    """Each word of the text begins a candidate."""
    monkeypatch.setattr(decontaminate, "CELL", cell)
    n = 60_000 if cell == 256 else 300
    rows = [(1, "a " * n), (2, "a b " * (n // 2)), (3, "b " * 700 + "a " * 11 + "b " * 700), (4, None)]
    items = [(1, "a " * 12), (2, "b a " * 6), (3, "b " * 5 + "a " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = {x["id"]: (x["n_words"], x["n_hit"], x["item_ids"]) for x in decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert r == {1: (n, n, ["1"]), 2: (n, n, ["2"]), 3: (1411, 16, ["1", "3"]), 4: (0, 0, [])}
