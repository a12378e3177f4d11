"""WARC archives: a deterministic sharded writer and its reader.

Records are in the order of their ids (those of one id by a hash of url and digest, the url and the digest) and cut into shards
at fixed marks of the payloads' bytes added up in that order (``Cuts``). Each shard is a run of gzip members (one per record,
without a time stamp) that rolls to a new file when the compressed size is reached. Lengths, digests, record ids and dates are
made anew from the payload, the id, the url and a date given as parameter, so equal input gives equal files on any cluster. Tasks
write under temporary names and give each finished file its final one; the driver, which sees a row per file, writes the
manifest last.

A payload that several records share is stored once, by the record with the largest id; the others are revisits that refer
to it. Which that is follows from one aggregate per digest; it is written out and joined to the records' keys, a plain join
that the adaptive skew join splits where a third of all pages are one copy, and reaches the writer as a mark before the
record. Payloads move once, to be sorted.

Defined cases: a null payload is empty; a null id sorts first and is never referred to unless no other has its payload;
of rows equal in id and payload the one whose url is largest is the response; fully equal rows are written as often as
they occur, the first as response, each with a record id of its own; an empty table gives a manifest without files; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .common import Cuts, dealt_to_shards, drop, materialize, new_dir, shard_size

#: Compressed bytes of a file: an eighth of a shard's payloads, within these bounds.
LEAST_ROLL, MOST_ROLL = 1 << 20, 1 << 30
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(url: str | None) -> str:
    """A header value: control characters would end the line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url or "")


def _record_id(page: int | None, url: str | None, sha: str, ordinal: int = 0) -> str:
    """Of the page, its address and its payload, and of which it is of rows that are equal in all three."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page}:{ordinal}:{sha}:{url is None}:{url}')}>"


def record(page: int | None, url: str | None, payload: bytes, sha: str, length: int, refers_to: tuple[int | None, str | None] | None, date: str, ordinal: int = 0) -> bytes:
    """A response, or with refers_to (page and url of the response) a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_record_id(page, url, sha, ordinal)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_safe(url)}"] * (url is not None)
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"Page-Id: {page}"] * (page is not None) + [f"Payload-Length: {length}"]
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(*refers_to, sha)}"] + [f"Refers-To-Page: {refers_to[0]}"] * (refers_to[0] is not None)
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member; zlib writes no time stamp
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html", least_bytes: int = 0, roll_bytes: int | None = None, shard_bytes: int | None = None, date: str = DATE) -> dict:
    """Writes the archives; payloads of at least least_bytes are stored once. Sizes of files and shards go by the data unless they
    are given. Returns the manifest."""
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    slim = slim.withColumns({"sha": F.sha1("payload"), "length": F.octet_length("payload")}).withColumn("spot", F.xxhash64("url", "sha"))
    keys = materialize(slim.select("id", "url", "sha", "length", "spot"), "warc-keys")
    best = keys.groupBy("sha").agg(F.max(F.struct("id", "url")).alias("best"), F.count("*").alias("copies"))
    shared = materialize(best.where("copies > 1").select("sha", "best"), "warc-digests")
    size = shard_bytes or shard_size(keys.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0)
    roll = roll_bytes or min(MOST_ROLL, max(LEAST_ROLL, size // 8))
    cuts = Cuts(keys.select("id", "spot", (F.col("length") + 1).cast("long").alias("bytes")), size)
    # A mark for each record with a shared payload travels with the records to where they are sorted, and stands before
    # those that it is about; so payloads are shuffled once.
    marks = keys.where(F.col("length") >= least_bytes).join(shared, "sha").select("id", "url", "sha", "spot", "best").distinct()
    rows = slim.withColumns({"mark": F.lit(False), "best": F.lit(None).cast(marks.schema["best"].dataType)})
    both = rows.unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True).withColumns({"shard": cuts.shard(), "part": cuts.part()})
    by = ["shard", F.col("id").asc_nulls_first(), "part", "spot", F.col("url").asc_nulls_first(), "sha", F.col("mark").desc()]
    ordered = dealt_to_shards(both, len(cuts.firsts)).sortWithinPartitions(*by).select("shard", "id", "url", "payload", "sha", "length", "mark", "best")
    kinds = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("roll", pa.int32()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, roll_n, out, done = None, 0, None, []
        marked = best = last = None
        ordinal = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                done.append(out.close())
            out = None

        for b in batches:
            for r in b.to_pylist():
                key = (r["id"], r["url"], r["sha"])
                if r["mark"]:
                    marked, best = key, r["best"]
                    continue
                # Equal rows stand side by side: all but the first revisit it.
                ordinal = ordinal + 1 if key == last else 0
                last = key
                revisit = key == marked and (ordinal > 0 or key[:2] != (best["id"], best["url"]))
                sha = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                data = _member(record(r["id"], r["url"], r["payload"].encode(), sha, r["length"], (best["id"], best["url"]) if revisit else None, date, ordinal))
                if shard != r["shard"]:
                    close()
                    shard, roll_n = r["shard"], 0
                elif out is not None and out.bytes + len(data) > roll:
                    close()
                    roll_n += 1
                out = out or _File(folder, shard, roll_n)
                out.add(data)
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kinds)

    rows = sorted(ordered.mapInArrow(run, "file string, shard int, roll int, bytes long, records long").collect(), key=lambda r: (r["shard"], r["roll"]))  # one per file
    made = {"files": [{k: r[k] for k in ("file", "bytes", "records")} for r in rows], "records": sum(r["records"] for r in rows)}
    store.commit(folder, made)
    drop(keys)
    drop(shared)
    return made


class _File:
    """An archive while a task writes it."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.folder, self.shard, self.roll, self.bytes, self.records = folder, shard, roll, 0, 0
        self.temporary = store.temporary(folder)
        self.out = store.create(self.temporary)

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes, self.records = self.bytes + len(data), self.records + 1

    def close(self) -> dict:
        self.out.close()
        name = f"records-{self.shard:06d}-{self.roll:04d}.warc.gz"
        store.finish(self.folder, self.temporary, name)
        return {"file": name, "shard": self.shard, "roll": self.roll, "bytes": self.bytes, "records": self.records}


def members(data) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        out, end = [], False
        while not end:
            out.append(z.decompress(view[at : at + (1 << 16)]))
            at += min(1 << 16, len(view) - at) - len(z.unused_data)
            end = z.eof
            if not end and at >= len(view):
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record, the block digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if headers["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("a block doesn't have its digest")
    return headers, block.partition(b"\r\n\r\n")[2]


def records(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Reads the archives of a manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    files = spark.createDataFrame([(f["file"],) for f in store.manifest(folder)["files"]], "file string")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] * payloads
    number = lambda v: None if v is None else int(v)

    def row(data: bytes) -> dict:
        h, payload = parse(data)
        sha = h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] == "response" and (digest(payload) != sha or len(payload) != int(h["payload-length"])):
            raise ValueError("a payload doesn't have its digest")
        out = {"page_id": number(h.get("page-id")), "url": h.get("warc-target-uri"), "payload_bytes": int(h["payload-length"]), "payload_digest": sha}
        out |= {"record_type": h["warc-type"], "refers_to": number(h.get("refers-to-page"))}
        return out | ({"payload": payload} if payloads else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for data in members(store.read(f"{folder}/{name}")):
                    rows.append(row(data))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return files.repartition(max(1, len(store.manifest(folder)["files"]))).mapInArrow(run, kinds)


def write_and_read(pages: DataFrame, **options) -> DataFrame:
    spark = pages.sparkSession
    folder = new_dir(spark, "warc")
    write(pages, folder, **options)
    return records(spark, folder)
