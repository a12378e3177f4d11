import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import registry, vector_codes


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label). Every part against every entry, in every round."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    x = np.array([[int(np.floor(1024 * float(c))) for c in r[1]] for r in kept], object).reshape(len(kept), parts, -1)
    books = [[list(v) for v in x[:entries, p]] for p in range(parts)]

    def assign(p):
        far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
        return [min((far(v, c), e) for e, c in enumerate(books[p])) for v in x[:, p]]

    for _ in range(rounds):
        for p in range(parts):
            held = assign(p)
            for e in range(len(books[p])):
                mine = [v for v, (_, k) in zip(x[:, p], held) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [assign(p) for p in range(parts)]
    sums, out = {}, []
    for i, (k, _, label) in enumerate(kept):
        error = sum(last[p][i][0] for p in range(parts))
        sums[label] = sums.get(label, 0) + error
        out.append((k, "".join(f"{last[p][i][1]:02x}" for p in range(parts)), error, label))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(k), code, e, sums[label], sha) for k, code, e, label in out)


def query(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, error int, codes string, v string") if rows and len(rows[0]) == 6 else spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.op11_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((str(r["vec_id"]), *r[1:]) for r in got.collect())


def random_rows(n, width, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(int(k), [float(x) for x in np.float32(centres[rng.integers(12)] + rng.normal(size=width) * spread)], int(rng.integers(4)) if k % 5 else None) for k in rng.permutation(n)]


@pytest.mark.parametrize("n,width", [(330, 8), (270, 16), (40, 4), (1, 12)])
def test_equals_brute_force(spark, tmp_path, n, width):
    rows = random_rows(n, width, n)
    assert query(spark, rows, tmp_path) == brute(rows)


def test_blocks_of_few_vectors_and_few_entries(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 16 * 8)  # blocks of 16 vectors
    rows = random_rows(400, 8, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    for entries, rounds in ((1, 2), (2, 6), (7, 9), (7, 0)):
        coded, books = vector_codes.compress(df, entries=entries, rounds=rounds)
        coded = vector_codes.with_label_error(coded).select("id", vector_codes.code_string("codes").alias("code"), "error", "label_error")
        assert sorted((str(r[0]), *r[1:], books.sha256()) for r in coded.collect()) == brute(rows, entries=entries, rounds=rounds)


def test_defined_cases(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.5, 0.001, -0.001]
    rows = [
        (1, None, 1), (2, [0.1, None, 0.2, 0.3], 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], None), (5, [-inf, 0.0, 0.0, 0.0], 2),
        (None, [0.9, 0.8, 0.7, 0.6], None), (6, same, None), (6, same, None), (6, [0.5, -0.5, 0.001, -0.002], 3), (7, same, 3),
        *[(100 + k, [k / 1000, (k % 7) / 10, -k / 500, 0.0], k % 3) for k in range(400)],
    ]
    rows = [(*r, 1, "x", "y") for r in rows]  # columns that are called like those of the result and inside
    assert query(spark, rows, tmp_path) == brute([r[:3] for r in rows])


def test_large_whole_numbers(spark, tmp_path):
    rows = [(k, [float(np.float32((-1) ** k * (3e5 + 917.0 * (k * k % 101)))), float(k), 1e-30, -1e-30], 0) for k in range(300)]
    assert query(spark, rows, tmp_path) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        query(spark, [(1, [1e30, 0.0, 0.0, 0.0], 0)], tmp_path / "more")


def test_empty_and_unlike(spark, tmp_path):
    assert query(spark, [(1, None, 1)], tmp_path / "a") == []
    assert query(spark, [], tmp_path / "b") == []
    with pytest.raises(ValueError, match="unlike"):
        query(spark, [(1, [1.0, 2.0], 1), (2, [1.0], 1)], tmp_path / "c")


def test_most_parts_are_not_looked_at_again():
    """What the heaps are for: once entries hardly move, hardly any part is popped, and none that should be is missed."""
    rng = np.random.default_rng(5)
    x = vector_codes.whole((rng.integers(0, 10, 5000)[:, None] + rng.normal(size=(5000, 2)) * 0.05)).reshape(-1, 1, 2)
    books = vector_codes.Books(x[:10].transpose(1, 0, 2).copy())
    block, popped = vector_codes.Block.fresh(x, books), []
    for _ in range(12):
        held = block.held[0]
        counts = np.bincount(held, minlength=10)[None]
        sums = np.stack([np.bincount(held, x[:, 0, j], 10) for j in range(2)], 1)[None].astype(np.int64)
        books.move(counts, sums)
        block = vector_codes.Block.unpacked(x.shape, *block.packed())
        popped.append(len(block.rescan(books)[0][0]))
        assert np.array_equal(block.held[0], vector_codes.nearest(x[:, 0], books.entries[0])[0])
    assert popped[-1] < 5000 // 20 and sum(popped) < 5000 * 6
    for heap in block.keys[0]:
        assert all(heap[(k - 1) // 2] <= heap[k] for k in range(1, len(heap)))


def test_label_error_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    df = spark.createDataFrame([(1, 5, 2), (2, 5, 3), (3, None, 1), (4, None, 9)], "id long, label int, error long").withColumn("codes", F.array())
    assert {r["id"]: r["label_error"] for r in vector_codes.with_label_error(df).collect()} == {1: 5, 2: 5, 3: 10, 4: 10}
