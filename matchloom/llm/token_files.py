"""Token ids as flat unsigned integer files with 64-bit document offsets.

A shard has three files: ids (uint16 if the vocabulary allows, else uint32, little-endian), offsets (int64, one more than
documents, counted from the shard's start) and docs (int64 document ids; 0 where null). Documents are in ascending order of their
ids and cut into shards at fixed marks of the texts' bytes added up in that order (``Cuts``), so that the files
depend on the documents alone, not on the cluster. The manifest has each shard's base: the prefix sums of the shards' ids and
documents. Tasks write under temporary names and give each finished file its final one; the driver, which sees a row per
shard, writes the manifest last.

Texts are encoded by the tokenizers library. Of a tokenizer with the known normalizer and splitting rule (``PIECES``), which drops
white space and never merges across it, nor a letter or digit with the punctuation behind it, each distinct stretch between white space
is encoded once and remembered in a bounded table (``WORDS``); of any other whole texts are encoded.

Defined cases: a null or blank text has the end id alone; null ids come first (the manifest counts them); equal ids go by
text, those of an id with more bytes than a shard by a hash of the text first; repeated rows are written as often as they occur;
an empty table gives a manifest without shards; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .common import Cuts, dealt_to_shards, drop, materialize, new_dir, shard_size

#: Stretches that a Python worker remembers.
WORDS = 1_000_000
#: Fixed value: the splitting rule of the tokenizer whose stretches can be encoded apart.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_encoders: dict[tuple[str, str, bool | None], "Encoder"] = {}


_PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def _ends_in_letter(stretch: bytes) -> bool:
    return unicodedata.category(stretch.decode()[-1])[0] in "LN"


def in_stretches(tokenizer: dict) -> bool:
    """Whether a tokenizer (its parsed file) encodes stretches between white space as it would inside a whole text."""
    listed = lambda x, key: (x.get(key) or [x]) if x else []
    before, split = listed(tokenizer["normalizer"], "normalizers"), listed(tokenizer["pre_tokenizer"], "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or (n["type"], n.get("pattern"), n.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for n in before)
    first = split[0] if split else {}
    rule = (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": PIECES}, "Removed", True)
    byte_level = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in split[1:])
    return plain and rule and byte_level and not tokenizer.get("post_processor") and all(t["content"].startswith("<|") and not set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in tokenizer["added_tokens"])


class Encoder:
    def __init__(self, path: str, dtype: str, whole: bool | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.dtype, self.whole = dtype, not in_stretches(made) if whole is None else whole
        normalizer = made["normalizer"] or {}
        self.lower = any(n["type"] == "Lowercase" for n in normalizer.get("normalizers", [normalizer] if normalizer else []))
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each stretch, from one call over all of them: blanks part them, and offsets tell whose a token is."""
        texts = [p.decode() for p in parts]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        first = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        ids = np.array(found.ids, self.dtype)
        cuts = [0, *(np.searchsorted(first, ends) * ids.itemsize).tolist()]
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, parts: set[bytes]) -> None:
        """Remembers new stretches. What punctuation stands after the last letter or digit is a piece of its own to the tokenizer, so
        it is encoded apart, and a word once for all that may follow it."""
        stems = {p: s for p in parts if (s := p.rstrip(_PUNCTUATION)) and s != p and b"<|" not in p and (s[-1:].isalnum() if s[-1] < 128 else _ends_in_letter(s))}
        new = list({stems.get(p, p) for p in parts}.union(p[len(s) :] for p, s in stems.items()).difference(self.known))
        if new:
            self.known.update(zip(new, self._pieces(new), strict=True))
        for p, stem in stems.items():
            self.known[p] = self.known[stem] + self.known[p[len(stem) :]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts, as bytes."""
        if self.whole:
            return self._ids([t or "" for t in texts])
        out = []
        for t in texts:
            raw = (t or "").encode()
            # At ASCII white space. The tokenizer ignores case, but for the names of special tokens.
            parts = (raw if not self.lower or b"<|" in raw else raw.lower()).split()
            if new := {*parts}.difference(self.known):
                if len(self.known) + 2 * len(new) > WORDS:
                    self.known = {}
                    new = {*parts}
                self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, parts)))
        return out


def _encoder(path: str, dtype: str, whole: bool | None) -> Encoder:
    """One for each Python worker, kept from task to task."""
    key = (path, dtype, whole)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, id_col="doc_id", text_col="text", whole: bool | None = None, shard_bytes: int | None = None) -> dict:
    """Writes the documents in ascending id order; returns the manifest. whole: None tells by the tokenizer; shard_bytes (of text):
    None goes by the data."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(vocabulary - 1, end_id or 0) < 1 << 16 else "<u4"
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("spot"))
    keys = materialize(slim.select("id", "spot", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("bytes")), "token-keys")
    size = shard_bytes or shard_size(keys.agg(F.sum("bytes")).first()[0] or 0)
    cuts = Cuts(keys, size)
    drop(keys)
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize
    kinds = pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("nulls", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer, dtype, whole), None
        for b in batches:
            of = b.column(0).to_numpy()
            # A batch may reach into further shards.
            marks = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(marks, marks[1:]):
                if lo == hi:
                    continue
                if shard is None or shard.number != of[lo]:
                    if shard is not None:
                        yield pa.RecordBatch.from_pylist([shard.close()], schema=kinds)
                    shard = _Shard(folder, int(of[lo]))
                part = b.slice(lo, hi - lo)
                shard.add(part.column(1), [x + end for x in encoder.encode(part.column(2).to_pylist())], width)
        if shard is not None:
            yield pa.RecordBatch.from_pylist([shard.close()], schema=kinds)

    placed = slim.withColumns({"shard": cuts.shard(), "part": cuts.part()}).select("shard", "id", "text", "part")
    ordered = dealt_to_shards(placed, len(cuts.firsts)).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "part", "text").select("shard", "id", "text")
    rows = sorted(ordered.mapInArrow(run, "shard int, docs long, nulls long, ids long").collect(), key=lambda r: r["shard"])  # one per shard
    made_of, base, doc_base = [], 0, 0
    for r in rows:
        made_of.append({"shard": _name(r["shard"]), "docs": r["docs"], "nulls": r["nulls"], "ids": r["ids"], "base": base, "doc_base": doc_base})
        base, doc_base = base + r["ids"], doc_base + r["docs"]
    made = {"dtype": dtype, "ids": base, "docs": doc_base, "end_id": end_id, "shards": made_of}
    store.commit(folder, made)
    return made


def _name(shard: int) -> str:
    return f"shard-{shard:06d}"


class _Shard:
    """The three files of a shard while a task writes them."""

    def __init__(self, folder: str, number: int):
        self.folder, self.number, self.name = folder, number, store.temporary(folder)
        self.files = {k: store.create(f"{self.name}.{k}") for k in ("ids", "offsets", "docs")}
        self.files["offsets"].write(np.array([0], "<i8").tobytes())
        self.docs = self.nulls = self.ids = 0

    def add(self, keys: pa.Array, parts: list[bytes], width: int) -> None:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
        self.files["ids"].write(b"".join(parts))
        self.files["offsets"].write((self.ids + np.cumsum(sizes)).astype("<i8").tobytes())
        self.files["docs"].write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.docs, self.nulls, self.ids = self.docs + len(parts), self.nulls + keys.null_count, self.ids + int(sizes.sum())

    def close(self) -> dict:
        for k, f in self.files.items():
            f.close()
            store.finish(self.folder, f"{self.name}.{k}", f"{_name(self.number)}.{k}")
        return {"shard": self.number, "docs": self.docs, "nulls": self.nulls, "ids": self.ids}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Reads a folder back: a row per document with doc_id, start, n_tokens, ids_crc32."""
    made = store.manifest(folder)
    dtype = made["dtype"]
    schema = "shard string, base long, nulls long"
    listed = spark.createDataFrame([(s["shard"], s["base"], s["nulls"]) for s in made["shards"]], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                path = f"{folder}/{s['shard']}"
                ids = np.frombuffer(store.read(f"{path}.ids"), dtype)
                at, keys = np.frombuffer(store.read(f"{path}.offsets"), "<i8"), np.frombuffer(store.read(f"{path}.docs"), "<i8")
                for lo in range(0, len(keys), 4096):
                    hi = min(lo + 4096, len(keys))
                    crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[lo:hi], mask=np.arange(lo, hi) < s["nulls"]),
                            pa.array(at[lo:hi] + s["base"]),
                            pa.array(np.diff(at[lo : hi + 1])),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return listed.repartition(max(1, len(made["shards"]))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(folder: str, document: int) -> np.ndarray:
    """The ids of the document at that place of the whole set, memory-mapped."""
    made = store.manifest(folder)
    s = next(s for s in reversed(made["shards"]) if s["doc_base"] <= document)
    at = np.frombuffer(store.read(f"{folder}/{s['shard']}.offsets"), "<i8")
    i = document - s["doc_base"]
    return np.frombuffer(store.read(f"{folder}/{s['shard']}.ids"), made["dtype"])[at[i] : at[i + 1]]


def encode_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    spark = docs.sparkSession
    folder = new_dir(spark, "tokens")
    write(docs, folder, tokenizer, **options)
    return documents(spark, folder)
