import hashlib
import re
from collections import Counter

import pytest

from matchloom.llm import quality

from .conftest import words


def brute(rows, rules=quality.Rules()):
    """rows: (doc_id, text, source)."""

    def lines(text):
        return [words(re.sub("[0-9]+", "0", x).lower()) for x in (text or "").split("\n")]

    holders = {}
    for key, text, host in rows:
        for line in {tuple(x) for x in lines(text) if x}:
            holders.setdefault((host, line), set()).add((text or "",) if rules.distinct == "text" else (key, text or ""))
    out = []
    for key, text, host in rows:
        w = words(text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        with_word = [x for x in (text or "").split("\n") if words(x)]
        often = [bool(x) and len(holders[host, tuple(x)]) > rules.max_line_documents for x in lines(text)]
        cut = sum(len(x) for x, o in zip(lines(text), often) if o)
        clean = [x for x, o in zip((text or "").split("\n"), often) if not o]
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        left = len(w) - cut
        depleted = cut > 0 and (left < rules.min_words or 100 * left < rules.min_left_percent * len(w))
        figures = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(with_word) - len(set(with_word)), len(hit), cut)
        out.append((key, *figures, len("\n".join(clean)), md5(",".join(map(md5, clean))), failed, not failed and not depleted))
    return sorted(out, key=str)


def rows_of(df):
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate", "clean_chars", "clean_md5", "base_failed", "kept"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_equals_brute_force(docs, texts):
    hosts = {r["doc_id"]: r["source"] for r in docs.collect()}
    rules = quality.Rules(max_line_documents=1)
    assert rows_of(quality.judge(docs, rules=rules)) == brute([(k, t, hosts[k]) for k, t in texts.items()], rules)


def test_edge_cases(edge):
    assert rows_of(quality.judge(edge)) == brute([(r["doc_id"], r["text"], r["source"]) for r in edge.collect()])


def test_boilerplate_is_cut_and_depleted_documents_go(spark):
    own = lambda i: " ".join(f"own{chr(65 + i)}x{chr(65 + k)}" for k in range(40))  # digits would be one to the rule
    rows = [(i, f"Subscribe to our news letter number {i}\n{own(i)}", "h") for i in range(30)]
    rows += [(100, "\n".join(f"subscribe TO our  news letter number {k}" for k in range(5)), "h")]
    rows += [(200, "\n".join(f"subscribe to our news letter number {k}" for k in range(5)), "other")]
    copies = [(300 + i, "one text of which there are a great many copies in this host alone and more", "h") for i in range(60)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, source string")
    got = {r["id"]: r for r in quality.judge(df, rules=quality.Rules(max_repeat_percent=100)).collect()}
    assert got[0]["n_boilerplate"] == 7 and got[0]["kept"]
    assert not got[100]["kept"] and got[100]["n_boilerplate"] == 35
    assert got[200]["kept"], "the other host has it in one document only"
    assert all(got[300 + i]["kept"] for i in range(60)), "copies of one text are one document"


def test_keep_returns_all_columns_of_the_kept(edge):
    kept = quality.keep(edge)
    assert kept.columns == edge.columns
    want = {(r["id"], r["body"]) for r in quality.judge(edge).where("kept").collect()}
    assert kept.count() == sum(1 for r in quality.judge(edge).where("kept").collect())
    assert want and 4 in [r["doc_id"] for r in kept.collect()]


def test_empty_table(empty):
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0


def test_no_python_in_the_plans(edge):
    table = quality.figures(edge)
    for df in (table, quality.decided(table), quality.frequent_lines(table), quality.judge(edge), quality.keep(edge)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_documents_can_be_told_apart_by_id(spark):
    rows = [(i, "one line that all the copies of this text have in common with each other\nand a second one of a few words", "h") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rules = quality.Rules(distinct="id")
    assert rows_of(quality.judge(df, rules=rules)) == brute(rows, rules) and not any(r["kept"] for r in quality.judge(df, rules=rules).collect())
    assert all(r["kept"] for r in quality.judge(df).collect())


def test_lines_of_any_length_count(spark):
    long = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300))
    rows = [(i, f"{long}\nown words of document {chr(97 + i)} which are enough to be kept, {'really ' * 2}{chr(97 + i)} {chr(98 + i)}x", "h") for i in range(21)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(quality.judge(df))
    assert got == brute(rows) and all(r[6] == 300 for r in got)


@pytest.mark.parametrize("n", [4, 5, 6, 9, 10, 11])
def test_repeats_at_the_edges(spark, n):
    text = " ".join("ab"[i % 2] for i in range(n))
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert rows_of(quality.judge(df)) == brute([(1, text, "s")])


def test_keep_takes_boilerplate_lines_out_of_the_text(spark):
    own = lambda i: " ".join(f"own{chr(97 + i)}{chr(97 + k)}" for k in range(12))
    rows = [(i, f"Menu {i}\n\n{own(i)}\nMENU  {i + 1}\n", "h") for i in range(21)]
    rows += [(0, rows[0][1], "h"), (50, rows[0][1], "other"), (None, rows[3][1], "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("source", "text", "doc_id", "1 AS r")
    got = quality.keep(df)
    cut = lambda i: f"\n{own(i)}\n"
    want = [("h", cut(i), i, 1) for i in range(21)] + [("h", cut(0), 0, 1), ("other", rows[0][1], 50, 1), ("h", cut(3), None, 1)]
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
