import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import byte_bpe, registry

from .conftest import SF

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.bpe(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def whole(bpe):
    """The library on whole texts."""
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={}).encode_ordinary


ALPHABET = list("aaab éßяж中文字，。ひら가나 012'''st\"re.,;!\n\n\t   \r") + ["'ll", "don't", " ", "　", "\x1c", "\x85", "​", "😀", "é", "\x00", "<|endoftext|>", "    ", "==="]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS, TEXTS)
def test_join_is_the_encoding_of_both(bpe, whole, a, b):
    assert bpe.join(whole(a), whole(b)) == whole(a + b)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_small_leaves(bpe, whole, text):
    old = byte_bpe.LEAF, byte_bpe.FIRST, byte_bpe.MOST, byte_bpe.RUN
    byte_bpe.LEAF, byte_bpe.FIRST, byte_bpe.MOST, byte_bpe.RUN = 3, 1, 4, 5
    try:
        assert bpe.encode(text) == whole(text)
        assert bpe.decode(bpe.encode(text)) == text.encode()
    finally:
        byte_bpe.LEAF, byte_bpe.FIRST, byte_bpe.MOST, byte_bpe.RUN = old


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.text(max_size=80))
def test_any_characters(bpe, whole, a, b):
    assert bpe.join(whole(a), whole(b)) == whole(a + b)


def test_runs(bpe, whole):
    rng = random.Random(3)
    for text in ("a" * 30_000, " " * 20_001 + "x", "x" + " " * 20_001, "=-" * 9_000, "7" * 12_345, "ab" * 8_000, "中" * 7_000, "\n" * 9_999, "'" * 5_000, "a'" * 5_000, "'re" * 5_000):
        assert bpe.encode(text) == whole(text)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "中文字母的一是不了人", "0123456789", "ACGT", "éèüñ", "=-+*", " \n\t"):
        for n in (2_049, 9_000, 30_000):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert bpe.encode(text) == whole(text), (letters, n)
            assert bpe.merged(text[:700].encode()) == bpe.encode_run(text[:700].encode())


def test_tokens_that_no_merge_makes(tmp_path):
    """A rank file with a token of its own that merges don't reach: a match that is this token, and longer ones that hold it."""
    import base64

    tokens = [bytes([k]) for k in range(256)] + [b"ab", b"cd", b"xyzw"]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    bpe = byte_bpe.Bpe(str(tmp_path / "ranks"), public_tokenizers.PATTERN)
    for a, b in (("xy", "zw"), ("xyzw", "xyzw"), ("a", "b"), ("xyzw", ""), ("ab" * 40 + "xyzw", "xyzw" * 40), ("c", "d" * 5000)):
        assert bpe.join(bpe.leaf.encode_ordinary(a), bpe.leaf.encode_ordinary(b)) == bpe.leaf.encode_ordinary(a + b)


def brute(whole, text):
    ids = whole(text or "")
    return len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_on_whole_tables(spark, texts, whole):
    rows = registry.op13_byte_bpe(spark, SF).collect()
    assert {r["doc_id"]: tuple(r[1:]) for r in rows} == {k: brute(whole, t) for k, t in texts.items()} and len(rows) == len(texts)


@pytest.mark.parametrize("part,fan", [(1 << 16, 16), (100, 2), (37, 3)])
def test_long_texts_and_defined_cases(spark, edge, empty, tmp_path, monkeypatch, whole, part, fan):
    monkeypatch.setattr(byte_bpe, "PART", part)
    monkeypatch.setattr(byte_bpe, "FAN", fan)
    edge.withColumnRenamed("n_words", "n_tokens").withColumnRenamed("kept", "ids").selectExpr("*", "1 AS row", "2 AS no", "3 AS id", "4 AS decoded").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op13_byte_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(r["doc_id"], *brute(whole, r["text"])) for r in edge.collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert byte_bpe.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0
