import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from matchloom.llm import store, warc
from matchloom.llm.common import new_dir

from .conftest import SF

PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3", "other"), (None, "http://n", "same"), (4, None, None), (5, "", ""), (6, "http://a/6 b\r\nc", "x" * 200_000),
    (7, "http://t1", "tie"), (7, "http://t2", "tie"), (8, "http://r", "repeated"), (8, "http://r", "repeated"), (9, "http://ü", "ü\r\n\r\n中"),
]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", i) for i, p in enumerate(PAGES)], "page_id long, url string, html string, record_type string, id int")


def test_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    df = df.union(df.where("page_id % 3 = 0").selectExpr("page_id + 100000", "url", "html"))
    rows = df.collect()
    best = {}
    for r in rows:
        best[r["html"]] = max(r["page_id"], best.get(r["html"], -1))
    want = sorted(
        ((r["page_id"], len((r["html"] or "").encode()), sha(r["html"]), *(("response", None) if best[r["html"]] == r["page_id"] else ("revisit", best[r["html"]]))) for r in rows), key=str
    )
    assert rows_of(warc.write_and_read(df)) == want


def test_edge_cases(spark, pages):
    got = rows_of(warc.write_and_read(pages))
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[3:])
    assert by[1] == [("revisit", 2)] and by[2] == [("response", None)] and by[None] == [("revisit", 2)]
    assert by[4] == [("revisit", 5)] and by[5] == [("response", None)]
    assert sorted(by[7], key=str) == [("response", None), ("revisit", 7)]
    assert sorted(by[8], key=str) == [("response", None), ("revisit", 8)]
    assert len(got) == len(PAGES)


def test_least_size(spark, pages):
    folder = new_dir(spark, "w")
    warc.write(pages, folder, least_bytes=5)
    types = {r["page_id"]: r["record_type"] for r in warc.records(spark, folder).collect()}
    assert types[1] == types[4] == "response"


def test_files_are_deterministic_and_roll(spark, pages):
    contents = []
    for parts in (1, 6):
        folder = new_dir(spark, "w")
        made = warc.write(pages.repartition(parts), folder, roll_bytes=600)
        assert len(made["files"]) > 1
        contents.append(b"".join(Path(folder, f["file"]).read_bytes() for f in made["files"]))
    assert contents[0] == contents[1]
    assert store.manifest(folder)["records"] == len(PAGES)


def folder_bytes(df, **options):
    folder = new_dir(df.sparkSession, "w")
    made = warc.write(df, folder, **options)
    assert sorted(p.name for p in Path(folder).iterdir() if p.name[0] != ".") == sorted(["manifest.json", *(f["file"] for f in made["files"])])
    return {p.name: p.read_bytes() for p in Path(folder).iterdir()}, made


def test_files_dont_depend_on_the_partitions(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    first, made = folder_bytes(df.repartition(3), shard_bytes=30_000, roll_bytes=6_000)
    assert len({f["file"][:14] for f in made["files"]}) > 3 and any(not f["file"].endswith("-0000.warc.gz") for f in made["files"])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert folder_bytes(df.repartition(11), shard_bytes=30_000, roll_bytes=6_000)[0] == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_record_ids_are_unique_and_refer_to_records(spark, pages):
    files, _ = folder_bytes(pages)
    heads = [warc.parse(m)[0] for name, data in files.items() if name.endswith(".gz") for m in warc.members(data)]
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(ids) == len(PAGES)
    responses = {h["warc-record-id"]: h["warc-payload-digest"] for h in heads if h["warc-type"] == "response"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert revisits and all(responses[h["warc-refers-to"]] == h["warc-payload-digest"] for h in revisits)


def test_null_and_repeated_ids_are_cut_up(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"http://h/{i}", f"page {i} " + "word " * (i % 30)) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    _, made = folder_bytes(df, shard_bytes=4000)
    assert len(made["files"]) > 10 and max(f["records"] for f in made["files"]) < 200 and made["records"] == 900


def test_very_long_payload(spark):
    text = "ü long page " * 150_000
    df = spark.createDataFrame([(1, "u", text), (2, "v", text)], "page_id long, url string, html string")
    size = len(text.encode())
    assert rows_of(warc.write_and_read(df)) == [(1, size, sha(text), "revisit", 2), (2, size, sha(text), "response", None)]


def test_archives_are_plain_gzip_with_payloads(spark, pages):
    folder = new_dir(spark, "w")
    made = warc.write(pages, folder)
    text = gzip.decompress(b"".join(Path(folder, f["file"]).read_bytes() for f in made["files"]))
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and b"http://a/6%20b%0D%0Ac" in text
    payloads = {r["page_id"]: r["payload"] for r in warc.records(spark, folder, payloads=True).where("record_type = 'response'").collect()}
    assert payloads[9].decode() == "ü\r\n\r\n中" and len(payloads[6]) == 200_000


def test_damage_is_found(spark, pages):
    data = warc.record(1, "u", b"payload", sha("payload"), 7, None, warc.DATE)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def test_empty_table(spark, pages):
    assert warc.write_and_read(pages.limit(0)).count() == 0
