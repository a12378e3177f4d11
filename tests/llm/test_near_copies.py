import random

import pytest

import corpus_pipeline
from matchloom.llm import near_copies, simhash


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """Component of each row by its place, from all pairs."""
    sets, up = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                up[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def first_ids(rows):
    least = {}
    for (k, _), c in zip(rows, brute(rows)):
        least[c] = min(least.get(c, k), k)
    return sorted(least.values())


def test_stage_keeps_one_of_each_group_of_near_copies(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == first_ids(rows) and got.columns == docs.columns


@pytest.fixture(scope="module")
def edited():
    """Edited copies of a text (0.8 or more to it, often less to each other), chains, and texts that share half."""
    rng, rows = random.Random(5), []
    word = lambda: f"w{rng.randrange(10**6)}"
    base, half = [word() for _ in range(150)], [word() for _ in range(60)]
    rows.append(base)
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(150), 3):
            w[at] = word()
        rows.append(w)
    chain = [word() for _ in range(200)]
    for step in range(8):
        chain = chain[6:] + [word() for _ in range(6)]
        rows.append(chain)
    rows += [half + [word() for _ in range(40)] for _ in range(40)]
    rows = [" ".join(w) for w in rows]
    rng.shuffle(rows)
    return [*enumerate(rows), (900, None), (901, " "), (902, "Two words"), (903, "two  WORDS"), (904, "two others")]


def test_components_equal_brute_force(spark, edited):
    df = spark.createDataFrame(edited, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_per_component(df, shingle=5, similarity=(4, 5)).collect()) == first_ids(edited)


def test_defined_cases(edge, empty):
    kept = simhash.one_per_component(edge, shingle=5, similarity=(4, 5))
    assert kept.columns == edge.columns and simhash.one_per_component(empty, shingle=5, similarity=(4, 5)).count() == 0
    assert [r["doc_id"] for r in kept.collect()].count(4) == 1


def test_hopeless_texts_are_those_that_share_too_little(spark):
    sets = [(1, list(range(10))), (2, list(range(8)) + [20, 21]), (3, list(range(7)) + [30, 31, 32]), (4, [30, 41])]
    rows = [(7, k, len(g), k) for k, g in sets]
    left, grams = spark.createDataFrame(rows, "bucket long, node long, n long, root long"), spark.createDataFrame(sets, "node long, grams array<long>")
    got = {r["node"]: r["shared"] for r in near_copies._hopeful(left, grams, (4, 5)).collect()}
    assert got == {}, "8 of 10 shared isn't enough for a text as long"
    # In a bucket of like sizes a link takes 8/9 of both.
    sets = [(1, list(range(18))), (2, list(range(15)) + [50, 51, 52]), (3, list(range(18)))]
    rows = [(7, k, len(g), k) for k, g in sets]
    left, grams = spark.createDataFrame(rows, "bucket long, node long, n long, root long"), spark.createDataFrame(sets, "node long, grams array<long>")
    assert {r["node"] for r in near_copies._hopeful(left, grams, (4, 5)).collect()} == {1, 3}
