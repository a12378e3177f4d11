"""Token counts by offset-mapped attribution.

A whole document is encoded once; the character span of each token is joined, as an interval, to the document's sections
by binary search over both sorted lists. A token that crosses a section's end is allocated by an explicit rule:

* ``first``: to the section that holds its first character (the default);
* ``last``: to the section that holds its last character;
* ``most``: to the section that holds most of its characters, the earlier of equals.

Under each rule a token counts once, so the sections' counts add up to the document's.

Of a byte-level tokenizer that changes nothing about a text (no normalizer, no prefix) the tokens' bytes follow each other and make
up the text, so that their spans are sums of their lengths; of any other the tokenizer's own spans are taken.

Defined cases: a null or empty text has one empty section without tokens; characters outside all sections count for
section -1; repeated rows each get their sections; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most")
#: Characters of the texts that are encoded in one call.
CALL = 1 << 20
_spanners: dict[str, "Spanner"] = {}


class Spanner:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.bytes_of: np.ndarray | None = None
        if (made["normalizer"], made["post_processor"], split.get("type"), split.get("add_prefix_space"), made["model"].get("continuing_subword_prefix"), made["model"].get("end_of_word_suffix")) == (None, None, "ByteLevel", False, None, None):
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, k in vocabulary.items():
                self.bytes_of[k] = len(token)  # one letter stands for a byte

    def spans(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Of each text, encoded whole and once: start and end of each token, in characters."""
        held: list[str] = []
        size = 0
        for t in [*texts, None]:
            if held and (t is None or size + len(t) > CALL):
                yield from self._spans(held)
                held, size = [], 0
            if t is not None:
                held.append(t)
                size += len(t)

    def _spans(self, texts: list[str]) -> Iterator[np.ndarray]:
        if self.bytes_of is None:
            for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
                yield np.array(e.offsets, np.int64).reshape(-1, 2)
            return
        for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            raw = t.encode()
            end = np.cumsum(self.bytes_of[np.array(e.ids, np.int64)])
            if (end[-1] if len(end) else 0) != len(raw):
                raise ValueError("the tokens don't make up the text")
            start = np.concatenate([np.zeros(min(1, len(end)), np.int64), end[:-1]])
            if len(raw) != len(t):
                place = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1  # of each byte the character it is of
                start, end = place[start], place[end - 1] + 1
            yield np.stack([start, end], 1)


def _spanner(path: str) -> Spanner:
    if path not in _spanners:
        _spanners[path] = Spanner(path)
    return _spanners[path]


def lines(text: str) -> list[tuple[int, int]]:
    """Sections of a text: its lines, each with the line end that closes it."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def attribute(spans: np.ndarray, sections: list[tuple[int, int]], rule: str = "first") -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and crossing tokens of each section (sorted, not overlapping), and the tokens outside all sections."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    begin, end = np.array([s for s, _ in sections], np.int64), np.array([e for _, e in sections], np.int64)
    start, stop = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    find = lambda at: np.searchsorted(begin, at, "right") - 1
    a, b = find(start), find(stop - 1)
    crossing = a != b
    pick = b.copy() if rule == "last" else a.copy()
    if rule == "most":
        for i in np.flatnonzero(crossing):  # few: only tokens over a border
            shares = [(min(stop[i], end[k]) - max(start[i], begin[k]), -k) for k in range(max(a[i], 0), b[i] + 1)]
            pick[i] = -max(shares)[1]
    held = pick >= 0
    at = start if rule == "first" else stop - 1
    if rule != "most":
        held &= at < end[np.maximum(pick, 0)]
    n = len(sections)
    return np.bincount(pick[held], minlength=n), np.bincount(pick[held & crossing], minlength=n), int((~held).sum())


def count(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", rule: str = "first", sections_col: str | None = None) -> DataFrame:
    """A row per section: id, section, start, end (characters), n_tokens, n_crossing, doc_tokens. Sections are the lines, or
    the array<struct<start,end>> in sections_col, which must be sorted and not overlap."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    cut = [] if sections_col is None else [F.col(sections_col).alias("sections")]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *cut)
    names = ["section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spanner = _spanner(tokenizer)
        for b in batches:
            rows, cols = [], [[] for _ in names]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, (text, spans) in enumerate(zip(texts, spanner.spans(texts), strict=True)):
                parts = lines(text) if sections_col is None else [(s["start"], s["end"]) for s in b.column(2)[i].as_py() or []]
                if parts:
                    got, crossing, outside = attribute(spans, parts, rule)
                else:
                    got, crossing, outside = np.zeros(0, np.int64), np.zeros(0, np.int64), len(spans)
                ids, starts, ends = list(range(len(parts))), [s for s, _ in parts], [e for _, e in parts]
                got, crossing = got.tolist(), crossing.tolist()
                if outside:
                    ids, starts, ends, got, crossing = [-1, *ids], [None, *starts], [None, *ends], [outside, *got], [0, *crossing]
                rows += [i] * len(ids)
                for c, v in zip(cols, (ids, starts, ends, got, crossing, [len(spans)] * len(ids)), strict=True):
                    c += v
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], ["id", *names])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names))
