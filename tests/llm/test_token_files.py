import zlib

import numpy as np
import pytest

from matchloom.llm import store, token_files
from matchloom.llm.common import new_dir
from matchloom.llm.registry import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def direct(text):
    from tokenizers import Tokenizer

    direct.t = getattr(direct, "t", None) or Tokenizer.from_file(PATH)
    return direct.t.encode(text or "", add_special_tokens=False).ids


def want(rows):
    out, start = [], 0
    for key, text in rows:
        ids = np.array([*direct(text), 2], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def got(spark, df, **options):
    folder = new_dir(spark, "t")
    token_files.write(df, folder, PATH, **options)
    return folder, [tuple(r) for r in token_files.documents(spark, folder).orderBy("start").collect()]


@pytest.mark.parametrize("shard_bytes", [None, 20_000])
def test_equals_direct_encoding(spark, docs, texts, shard_bytes):
    folder, rows = got(spark, docs.repartition(5), shard_bytes=shard_bytes)
    assert rows == want(sorted(texts.items()))
    assert store.manifest(folder)["dtype"] == "<u2"
    assert token_files.tokens(folder, 3).tolist() == [*direct(texts[3]), 2]


def test_edge_cases(spark, edge):
    rows = sorted(((r["doc_id"], r["text"]) for r in edge.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert got(spark, edge)[1] == want(rows)


def test_empty_table(spark, empty):
    folder, rows = got(spark, empty)
    assert rows == [] and store.manifest(folder)["shards"] == []


def test_whole_texts_and_wide_ids(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, "x\n\ny")], "doc_id long, text string")
    folder = new_dir(spark, "t")
    made = token_files.write(df, folder, tokenizer_path("byte_bpe_50k.json"), end_id=70_000, whole=True)
    assert made["dtype"] == "<u4"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert token_files.tokens(folder, 1).tolist() == [*t.encode("x\n\ny", add_special_tokens=False).ids, 70_000]


def test_an_unfinished_folder_is_not_read(spark):
    folder = new_dir(spark, "t")
    store.create(f"{folder}/_tmp/abandoned.ids").close()
    with pytest.raises(FileNotFoundError):
        token_files.documents(spark, folder)
    store.commit(folder, {"shards": []})
    where, base = store.of(folder)
    assert [f.base_name for f in where.get_file_info(store.fs.FileSelector(base))] == ["manifest.json"]


def test_only_known_tokenizers_are_encoded_in_stretches(spark, texts):
    assert not token_files.Encoder(PATH, "<u2", None).whole
    other = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    e, t = token_files.Encoder(other, "<u2", None), Tokenizer.from_file(other)
    some = list(texts.values())[:20]
    assert e.whole and [np.frombuffer(b, "<u2").tolist() for b in e.encode(some)] == [t.encode(x or "", add_special_tokens=False).ids for x in some]


def test_hot_ids_and_null_ids_are_cut_up(spark):
    """A third of all rows have one id, a third none: no shard takes them all, and the order holds."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} " + "word " * (i % 30)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder, got_rows = got(spark, df, shard_bytes=4000)
    shards = store.manifest(folder)["shards"]
    assert len(shards) > 10 and max(s["docs"] for s in shards) < 200
    keys = [r[0] for r in got_rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    crc = lambda rows: sorted((str(k), n, c) for k, _, n, c in rows)
    assert crc(got_rows) == crc(want(rows))
    assert [r[1] for r in got_rows] == [0, *np.cumsum([r[2] for r in got_rows])[:-1].tolist()]


def test_files_dont_depend_on_the_partitions(spark, docs):
    def files(df):
        folder = new_dir(spark, "t")
        token_files.write(df, folder, PATH, shard_bytes=100_000)
        where, base = store.of(folder)
        return {f.base_name: bytes(store.read(f.path)) for f in where.get_file_info(store.fs.FileSelector(base))}

    first = files(docs.repartition(3))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert files(docs.repartition(11)) == first and len(first) > 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_punctuation_behind_words():
    """What may be encoded apart and what may not: quotes, controls, marks, special tokens, letters of other scripts."""
    odd = ["a' b'. c's' d'll! é! é! ①) x\u0301... ²; <|endoftext|>. <|startoftext|>) don't), (a) [b]. 3.14, 5%. $$$ ... 中文。, µm; ßß— — a— 'tis' 's 't!", "’s’! it’s. “q”.", "a\x7f. b\x00! \x1c. a\x7f\x7f! '.", "word%%% word$$$ word&&&. word.%%% WORD!!"]
    e = token_files.Encoder(PATH, "<u2", None)
    assert [np.frombuffer(b, "<u2").tolist() for b in e.encode(odd)] == [direct(x) for x in odd]


def test_a_very_long_text_is_encoded_whole(spark):
    text = "a few Words, again. " * 60_000
    assert got(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"))[1] == want([(1, text)])


def test_a_small_memory_gives_the_same(monkeypatch, texts):
    monkeypatch.setattr(token_files, "WORDS", 50)
    e = token_files.Encoder(PATH, "<u2", False)
    assert [np.frombuffer(b, "<u2").tolist() for b in e.encode(list(texts.values())[:20])] == [direct(t) for t in list(texts.values())[:20]]
