import numpy as np
import pytest

from matchloom.llm import attribution, registry
from matchloom.llm.registry import tokenizer_path

from .conftest import SF

PATH = tokenizer_path("byte_bpe_50k.json")


def brute(spans, sections, rule):
    got, crossing, outside = [0] * len(sections), [0] * len(sections), 0
    for s, e in spans:
        e = max(e, s + 1)
        share = [max(0, min(e, b) - max(s, a)) for a, b in sections]
        at = {"first": lambda: next((i for i, (a, b) in enumerate(sections) if a <= s < b), -1), "last": lambda: next((i for i, (a, b) in enumerate(sections) if a <= e - 1 < b), -1), "most": lambda: share.index(max(share)) if any(share) else -1}[rule]()
        if at < 0:
            outside += 1
            continue
        got[at] += 1
        crossing[at] += sum(x > 0 for x in share) > 1
    return got, crossing, outside


@pytest.mark.parametrize("rule", attribution.RULES)
def test_rules_equal_brute_force(rule):
    rng = np.random.default_rng(3)
    for _ in range(200):
        cuts = sorted({0, *rng.integers(1, 40, 5).tolist(), 40})
        sections = list(zip(cuts, cuts[1:], strict=False))
        ends = np.cumsum(rng.integers(1, 6, 12))
        spans = np.stack([np.concatenate([[0], ends[:-1]]), ends], 1)
        spans = spans[spans[:, 1] <= 40]
        got, crossing, outside = attribution.attribute(spans, sections, rule)
        assert (got.tolist(), crossing.tolist(), outside) == brute(spans.tolist(), sections, rule)


@pytest.mark.parametrize("path", [PATH, tokenizer_path("word_bpe_49k.json")])
def test_spans_equal_the_tokenizers_own(texts, edge, path, monkeypatch):
    monkeypatch.setattr(attribution, "CALL", 5000)
    s = attribution.Spanner(path)
    assert (s.bytes_of is not None) == (path == PATH)
    rows = [t or "" for t in [*texts.values(), *(r["text"] for r in edge.collect()), "a    b\n\n\nc  \t d", "  lead", "trail \n ", "", "ü 中文 😀 e\u0301", "long " * 300_000]]
    got = list(s.spans(rows))
    assert len(got) == len(rows)
    for text, spans in zip(rows, got):
        assert [tuple(x) for x in spans.tolist()] == s.tokenizer.encode(text, add_special_tokens=False).offsets


def test_query_equals_brute_force(spark, texts):
    """Every section of every document, from the tokenizer's own spans."""
    t = attribution.Spanner(PATH).tokenizer
    want = set()
    for k, text in texts.items():
        text = text or ""
        parts = text.splitlines(keepends=True) if set(text) & set("\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029") == set() else [x + "\n" for x in text.split("\n")[:-1]] + [x for x in text.split("\n")[-1:] if x]
        ends = np.cumsum([len(x) for x in parts]).tolist() or [0]
        sections = list(zip([0, *ends[:-1]], ends))
        spans = t.encode(text, add_special_tokens=False).offsets
        n, crossing, outside = brute(spans, sections, "first")
        assert not outside
        want |= {(k, i, s, e, a, b, len(spans)) for i, ((s, e), a, b) in enumerate(zip(sections, n, crossing))}
    got = [tuple(r[c] for c in ("doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens")) for r in registry.op5_token_counts(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_sections_add_up(docs, texts):
    rows = attribution.count(docs, PATH).collect()
    per = {}
    for r in rows:
        per.setdefault(r["id"], []).append(r)
    for k, t in texts.items():
        own = sorted(per[k], key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in own) == own[0]["doc_tokens"]
        assert "".join((t or "")[r["start"] : r["end"]] for r in own) == (t or "")


def test_crossing_tokens(spark):
    df = spark.createDataFrame([(1, "ab cd", [(0, 1), (1, 5)]), (2, "abc", [(1, 2)]), (3, "abc", None)], "doc_id long, text string, parts array<struct<start:long,end:long>>")
    r = {(x["id"], x["section"]): x["n_tokens"] for x in attribution.count(df, PATH, sections_col="parts").collect()}
    assert r[1, 0] == 1 and r[2, -1] + r.get((2, 0), 0) == 1 and r[3, -1] == 1


def test_edge_cases(edge, empty):
    rows = attribution.count(edge, PATH).collect()
    own = lambda k: sorted((r["section"], r["start"], r["end"], r["n_tokens"] > 0) for r in rows if r["id"] == k)
    assert {r["id"] for r in rows} == {r["doc_id"] for r in edge.collect()}
    assert own(1) == own(2) == [(0, 0, 0, False)] and own(4) == [(0, 0, 70, True)] * 2 and len(own(5)) == 2 and len(own(3)) == 2 and len(own(None)) == 1
    assert attribution.count(empty, PATH).count() == 0
    with pytest.raises(ValueError, match="rule"):
        attribution.count(edge, PATH, rule="other")
