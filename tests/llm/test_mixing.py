import pytest

from matchloom.llm import mixing

from .conftest import words


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Water-filling in rounds: what is above its limit is cut to it, and the excess reshared, until none is."""
    w, out = [weights[i % len(weights)] for i in range(len(sizes))], [0.0] * len(sizes)
    free, left = set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
            free.remove(i)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [0, 0], [5, 1000, 10, 0, 77, 12345], [7], list(range(0, 4000, 13))])
def test_targets(spark, sizes):
    names = sorted(f"s{k}" for k in range(len(sizes) - 1)) + [None]  # the null source is the last
    rows = [(n, " ".join("w" * k), i) for i, (n, k) in enumerate(zip(names, sizes))]
    df = spark.createDataFrame(rows, "source string, text string, doc_id long")
    got = sorted(mixing.plan(df).collect(), key=lambda r: r["number"])
    assert [(r["source"], r["source_size"], r["documents"]) for r in got] == [(n, k, 1) for n, k in zip(names, sizes)]
    assert [r["target"] for r in got] == pytest.approx(targets(sizes))
    assert mixing.plan(df.limit(0)).count() == 0


def test_many_sources_are_no_limit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 10)  # joined by shuffle
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 50 as int)) AS text", "concat('s', id % 2000) AS source")
    out, mix = mixing.assign(df)
    rows = [(r["source"], r["doc_id"], r[mix]) for r in out.collect()]
    sizes = {}
    for s, k, m in rows:
        sizes[s] = sizes.get(s, 0) + m["size"]
    want = dict(zip(sorted(sizes), targets([sizes[s] for s in sorted(sizes)])))
    assert len(rows) == 3000 and all(m["target"] == pytest.approx(want[s]) and m["source_size"] == sizes[s] for s, _, m in rows)


def test_null_and_repeated_ids_spread(spark):
    df = spark.range(9000).selectExpr("cast(null as long) AS doc_id", "concat('w ', id) AS text", "'h' AS source")
    out, mix = mixing.assign(df)
    assert out.selectExpr(f"sum({mix}.copies)").first()[0] in (13500, 13499, 13501)


def rows_of(df):
    out, mix = mixing.assign(df)
    return [(r["doc_id"], r["text"], r["source"], r[mix]) for r in out.collect()]


def test_mix_comes_near_its_targets(docs):
    rows = rows_of(docs)
    assert rows and len(rows) == docs.count()
    per = {}
    for _, text, source, m in rows:
        assert m["size"] == len(words(text)) and 0 <= m["copies"] <= 2
        t = per.setdefault(source, [m["target"], m["source_size"], 0, 0, 0])
        t[2] += m["copies"] * m["size"]
        t[3] += m["size"]
        t[4] = max(t[4], m["size"])
    for target, size, taken, total, largest in per.values():
        assert size == total
        assert abs(taken - target) <= largest
    assert sorted(map(str, rows)) == sorted(map(str, rows_of(docs))), "reruns agree"
    assert sorted(map(str, rows)) == sorted(map(str, rows_of(docs.repartition(7)))), "whatever the partitions"


def test_edge_cases(edge):
    rows = rows_of(edge)
    assert len(rows) == edge.count()
    null = [m for _, _, s, m in rows if s is None]
    assert [m["source_size"] for m in null] == [0] and null[0]["copies"] == 0
    out = mixing.emit(edge)
    assert out.columns == edge.columns
    assert out.count() == sum(m["copies"] for *_, m in rows)


def test_empty_table(empty):
    assert rows_of(empty) == [] and mixing.emit(empty).count() == 0


def test_a_hot_source_is_dealt_out(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 50 as int)) AS text", "case when id % 3 = 0 then 'hot' else cast(id % 40 as string) end AS source")
    out, mix = mixing.assign(df)
    r = out.where("source = 'hot'").selectExpr(f"sum({mix}.copies * {mix}.size) t", f"max({mix}.target) g").first()
    assert abs(r["t"] - r["g"]) <= 50


def test_ties_in_id_and_text_go_by_the_other_columns(spark):
    rows = [(1, "a text of some words", "h", k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix int")
    got = [sorted(map(tuple, mixing.emit(df.repartition(n)).collect())) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 60


def test_prefix_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(s, c, p, (s + 2 * c + 3 * p) % 5) for s in range(2) for c in range(4) for p in range(11)]
    got = {(r["number"], r["cls"], r["part"]): r["base"] for r in mixing.prefix_sums(spark.createDataFrame(rows, "number int, cls long, part long, n long")).collect()}
    assert got == {(s, c, p): sum(n for s2, c2, p2, n in rows if s2 == s and (c2, p2) < (c, p)) for s, c, p, _ in rows}


@pytest.mark.parametrize("many", [False, True])
def test_columns_called_like_those_inside(spark, docs, monkeypatch, many):
    if many:
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    names = "documents target number source_size mix mix_key mix_source mix_base size u rate cls part base place b d p".split()
    plain = docs.select("doc_id", "text", "source")
    wide = plain.selectExpr("*", *[f"{k} AS {n}" for k, n in enumerate(names)], "named_struct('number', 1, 'source', 'x', 'documents', 2) AS s")
    copies = lambda df: sorted((r["doc_id"], r["text"]) for r in mixing.emit(df).collect())
    assert mixing.emit(wide).columns == wide.columns
    assert copies(wide) == copies(plain)
