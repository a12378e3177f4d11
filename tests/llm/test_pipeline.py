import zlib

import numpy as np
import pytest

import corpus_pipeline
from matchloom.llm import mixing, quality

from .conftest import SF, terms
from .test_near_copies import first_ids
from .test_quality import brute as brute_quality
from .test_token_files import direct


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
        out.append((docs, df))
        docs = df
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_quality_stage(stages):
    before, after = stages[0]
    want = {r[0] for r in brute_quality([(r["doc_id"], r["text"], r["source"]) for r in rows(before)], quality.Rules()) if r[-1]}
    assert {r["doc_id"] for r in rows(after)} == want and after.columns == before.columns


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    assert sorted(r["doc_id"] for r in rows(after)) == first_ids([(r["doc_id"], r["text"]) for r in rows(before)]) and after.columns == before.columns


def test_decontamination_stage(spark, stages):
    before, after = stages[2]
    wins = set()
    for r in rows(spark.read.parquet(f"{SF}/benchmark.parquet")):
        w = terms(r["text"])
        wins |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in wins}

    def hit(text):
        w = terms(text)
        return any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1))

    assert sorted(r["doc_id"] for r in rows(after)) == sorted(r["doc_id"] for r in rows(before) if not hit(r["text"]))
    assert after.columns == before.columns


def test_mixing_stage(stages):
    before, after = stages[3]
    out, mix = mixing.assign(before)
    assert after.count() == out.selectExpr(f"sum({mix}.copies)").first()[0] and after.columns == before.columns


def test_token_stage(stages):
    before, after = stages[4]
    start = 0
    got = sorted((tuple(r.values()) for r in rows(after)), key=lambda r: r[1])
    for r, (key, at, n, crc) in zip(sorted(rows(before), key=lambda r: (r["doc_id"], r["text"])), got, strict=True):
        ids = np.array([*direct(r["text"]), 2], "<u4")
        assert (key, at, n, crc) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_run_equals_its_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_quality_stage_counts_lines_of_any_length(spark):
    text = lambda tag, n: " ".join(f"{tag}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n))
    own = lambda i: text("own" + chr(97 + i), 12)
    notice, passage = text("notice", 25), text("passage", 60)
    rows = [(i, f"{notice}\n{passage}\n{own(i)}", "en", "h") for i in range(21)]
    rows += [(100 + i, f"{text('copy', 60)}\n{text('more', 12)}", "en", "h") for i in range(40)] + [(200, f"{notice}\n{own(24)}", "en", "other")]
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [*range(100, 140), 200]


def test_quality_stage_returns_texts_without_boilerplate(spark):
    own = lambda i: " ".join(f"own{chr(97 + i)}{chr(97 + k)}" for k in range(12))
    rows = [(i, f"All rights reserved\n{own(i)}", "h", 80) for i in range(21)]
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int"), "")
    assert sorted(map(tuple, got.collect())) == [(i, own(i), "h", len(own(i))) for i in range(21)]
