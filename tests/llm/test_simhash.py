import numpy as np
import xxhash

from matchloom.llm import simhash

from .conftest import ascii_lower, words


def brute_fingerprint(text):
    w = words(ascii_lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Representative fingerprint of each distinct one, by comparing all pairs."""
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in u}


def check(df, rows):
    """rows: (doc_id, text). Compares names of components by the documents in them."""
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    ids = {}
    for (k, _), f in zip(rows, fps, strict=True):
        if k is not None:
            ids[comp[f]] = min(k, ids.get(comp[f], k))
    want = sorted((str(k), f, ids.get(comp[f])) for (k, _), f in zip(rows, fps, strict=True))
    got = sorted((str(r["id"]), r["fp"] % (1 << 64), r["component_id"]) for r in simhash.components(df).collect())
    assert got == want


def test_equals_brute_force(docs, texts):
    check(docs, list(texts.items()))


def test_edge_cases(edge):
    check(edge, [(r["doc_id"], r["text"]) for r in edge.collect()])


def test_hash_is_that_of_the_engine(spark):
    from pyspark.sql import functions as F

    strings = ["", "a", "a b c", "ü" * 9, "x" * 100]
    got = [r[0] % (1 << 64) for r in spark.createDataFrame([(s,) for s in strings], "s string").select(F.xxhash64("s")).collect()]
    assert got == [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in strings]


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)] + [0, (1 << 64) - 1]
    fps = set(base)
    for f in base[:30]:  # flips of 1, 2 and 3 bits, within a segment and across
        for _ in range(12):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            for b in bits:
                f ^= 1 << int(b)
            fps.add(f)
    fps |= {1, 3, 7, 15, 1 << 63}  # a chain
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.contract(simhash.links(df)).collect()}
    comp = brute_components(fps)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({f: got.get(f, f) for f in fps}) == groups(comp)


def test_hot_cells_and_small_ones_link_the_same(spark, monkeypatch):
    """A cell of a few hundred fingerprints: one base with flips of one bit, and of two within a segment."""
    base, fps = 0x0123456789ABCDEF, {0x0123456789ABCDEF}
    fps |= {base ^ 1 << k for k in range(64)} | {base ^ 3 << k for k in range(0, 64, 2)} | {base ^ 1 << k ^ 1 << 63 for k in range(40)} | {base ^ 7 << k for k in range(0, 60, 7)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    comp = brute_components(fps)
    for cell in (1, 32, 10_000):
        monkeypatch.setattr(simhash, "CELL", cell)
        edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df).collect()]
        assert edges and all((a ^ b).bit_count() <= 2 for a, b in edges)
        got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.contract(simhash.links(df)).collect()}
        groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
        assert groups({f: got.get(f, f) for f in fps}) == groups(comp)


def test_ties_keep_the_same_row(spark):
    rows = [(1, "same text of rows that differ elsewhere", k) for k in (5, 3, 9, 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = {tuple(r) for n in (1, 3, 7) for r in simhash.one_per_component(df.repartition(n)).collect()}
    assert len(kept) == 1


def test_contraction_of_a_long_chain(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1001, 1000)]
    got = {r["node"]: r["root"] for r in simhash.contract(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}


def test_one_document_stays(spark, edge):
    kept = simhash.one_per_component(edge)
    assert kept.columns == edge.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(set(rows)), "of equal ids with unlike texts each component keeps its own"
    assert kept.count() == len({r["root"] for r in simhash.components(edge).collect()})


def test_empty_table(empty):
    assert simhash.components(empty).count() == 0 and simhash.one_per_component(empty).count() == 0
