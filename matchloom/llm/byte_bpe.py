"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

Encodings of neighbouring stretches of text form a monoid: ``join`` turns those of two neighbours into that of both, by encoding a
window around the border anew and growing it until all tokens outside are proved to stay. A text is encoded by halves down to leaves
of LEAF characters; a text of more than PART characters is cut into parts that different tasks encode, and further jobs join
neighbours, FAN parts at a time, so that a text's length is no task's length. Decoding concatenates the tokens' bytes by halves as well.

Why tokens outside a window stay:

* *Breaks.* The splitting pattern never matches across a letter that is followed by white space or a mark: letters are matched by runs
  of letters, or after an apostrophe that begins the match. So there is a border at a break whatever stands before and after, and the
  matches before it and after it don't depend on each other. The window goes from the left side's last break to the right side's first.
* *Pairs.* A window without breaks may be long, as in text without spaces: then it is few matches, each one run of characters. If a
  match is the left side's last and the right side's first in one, their tokens are joined. Tokens are a right encoding as a whole if
  each pair of neighbours is one: were some merge to go across borders, the first one that does would also be made if only the two
  tokens beside it were there, since until then nothing but merges inside tokens has happened. So a window of tokens around the
  border grows until the pairs at its ends are right.

Defined cases: a null or empty text has no tokens; control characters and strings of special tokens are ordinary text; repeated rows
are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Characters of a leaf, which is encoded in one call.
LEAF = 2048
#: Characters of a part: longer texts are spread over tasks.
PART = 1 << 16
#: Parts that a task joins.
FAN = 16
#: Characters of the first window that is looked at for a break; of a window that is encoded in one call.
FIRST, MOST = 64, 4096
#: Bytes of a run that is merged at once; longer ones are halved.
RUN = 512

#: Rows that a task turns over at a time.
ROWS = 256

#: Letters of long standing, and what ends a run of letters.
LETTER = r"A-Za-zÀ-ÖØ-öø-ɏА-яぁ-ゖァ-ヺ一-龥가-힣"
BREAK = regex.compile(rf"(?<=[{LETTER}])(?=[\t-\r !-/:-@\[-`{{-~、。！，？])")
#: White space by its property, in which the regex module and others differ.
SPACE = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


class Bpe:
    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        where, name = pyarrow.fs.FileSystem.from_uri(rank_file) if "://" in rank_file else (pyarrow.fs.LocalFileSystem(), rank_file)
        with where.open_input_file(name) as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, self.ranks))
        self.leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.fits = functools.lru_cache(1 << 16)(self._fits)

    # Runs: bytes of one match, or of a stretch of one.

    def merged(self, run: bytes) -> list[int]:
        """The pair of the lowest rank is merged, the leftmost of equals, until none is left."""
        n, ranks = len(run), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of where a token begins: its end (0 if none does), the last one's start
        heap = [(ranks[run[i : i + 2]], i, i + 2) for i in range(n - 1) if run[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            if not middle or middle >= n or after[middle] != end:
                continue  # one of the two has been merged since
            after[i], after[middle] = end, 0
            if end < n:
                before[end] = i
                self._offer(heap, run, i, after[end])
            if before[i] >= 0:
                self._offer(heap, run, before[i], end)
        out, i = [], 0
        while i < n:
            out.append(ranks[run[i : after[i]]])
            i = after[i]
        return out

    def _offer(self, heap: list[tuple[int, int, int]], run: bytes, start: int, end: int) -> None:
        if (rank := self.ranks.get(run[start:end])) is not None:
            heapq.heappush(heap, (rank, start, end))

    def _fits(self, a: int, b: int) -> bool:
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_run(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring stretches of one match: a window of tokens is merged anew until both its ends fit."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        size = 1
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            inner = self.merged(self.decode(left[a:]) + self.decode(right[:b]))
            if (a == 0 or self.fits(left[a - 1], inner[0])) and (b == len(right) or self.fits(inner[-1], right[b])):
                return left[:a] + inner + right[b:]
            size *= 2

    def encode_run(self, run: bytes) -> list[int]:
        """A match. One that is a token as a whole is that token."""
        if run in self.ranks:
            return [self.ranks[run]]
        return self._halved_run(run)

    def _halved_run(self, run: bytes) -> list[int]:
        if len(run) <= RUN:
            return self.merged(run)
        middle = len(run) // 2
        return self.join_run(self._halved_run(run[:middle]), self._halved_run(run[middle:]))

    # Texts.

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF:
            return self.leaf.encode_ordinary(text)
        middle = len(text) // 2
        return self.join(self.encode(text[:middle]), self.encode(text[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring texts from theirs."""
        if not left or not right:
            return left + right
        a, tail = self._last_break(left)
        b, head = self._first_break(right)
        if len(tail) + len(head) <= MOST:
            return left[:a] + self.leaf.encode_ordinary(tail + head) + right[b:]
        return left[:a] + self._between(tail, head, left[a:], right[:b]) + right[b:]

    def _between(self, tail: str, head: str, left: list[int], right: list[int]) -> list[int]:
        """A long window without breaks. left and right are the tokens of tail and head."""
        own, other = self.split.findall(tail), self.split.findall(head)
        out: list[int] = []
        at = 0
        for piece in self.split.findall(tail + head):
            end = at + len(piece)
            run = piece.encode()
            if end <= len(tail) - 2 and own and own[0] == piece and at == 0:
                out += self._span(left, 0, len(run))
            elif own and other and own[-1] + other[0] == piece and at == len(tail) - len(own[-1]):
                cut = len(own[-1].encode())
                sides = self._span(left, self._size(left) - cut, cut), self._span(right, 0, len(run) - cut)
                # A short match may be a token that no merges make, on either side or as a whole.
                out += self.encode_run(run) if len(run) <= self.longest else self.join_run(*(self.merged(self.decode(x)) if self._size(x) <= self.longest else x for x in sides))
            elif at >= len(tail) and other and other[-1] == piece and end == len(tail) + len(head):
                out += self._span(right, self._size(right) - len(run), len(run))
            else:
                out += self.encode_run(run)
            at = end
        return out

    def _size(self, tokens: Sequence[int]) -> int:
        return sum(len(self.bytes_of[t]) for t in tokens)

    def _span(self, tokens: list[int], start: int, size: int) -> list[int]:
        """The tokens of a stretch that begins and ends where tokens do."""
        ends = np.cumsum([len(self.bytes_of[t]) for t in tokens])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + size, "left")
        return tokens[a : b + 1]

    def _last_break(self, tokens: list[int]) -> tuple[int, str]:
        """Where the tokens after the last break begin, and their text."""
        size = FIRST
        while True:
            start = max(0, len(tokens) - size)
            while start and self._within(tokens[start]):
                start -= 1
            text = self.decode(tokens[start:]).decode(errors="replace")
            at = 0
            for at in (m.start() for m in BREAK.finditer(text)):
                pass
            if at:
                return start + self._index(tokens, start, len(text[:at].encode())), text[at:]
            if start == 0:
                return 0, text
            size *= 4

    def _first_break(self, tokens: list[int]) -> tuple[int, str]:
        size = FIRST
        while True:
            end = min(len(tokens), size)
            while end < len(tokens) and self._within(tokens[end]):
                end += 1
            text = self.decode(tokens[:end]).decode(errors="replace")
            if found := BREAK.search(text):
                return self._index(tokens, 0, len(text[: found.start()].encode())), text[: found.start()]
            if end == len(tokens):
                return end, text
            size *= 4

    def _within(self, token: int) -> bool:
        """Whether the token begins inside a character."""
        return self.bytes_of[token][0] & 0xC0 == 0x80

    def _index(self, tokens: list[int], start: int, size: int) -> int:
        """How many tokens from start on have so many bytes."""
        k = 0
        while size > 0:
            size -= len(self.bytes_of[tokens[start + k]])
            k += 1
        assert size == 0, "no token begins at a break"
        return k

    def decode(self, tokens: Sequence[int]) -> bytes:
        if len(tokens) <= 4096:
            return b"".join([self.bytes_of[t] for t in tokens])
        middle = len(tokens) // 2
        return self.decode(tokens[:middle]) + self.decode(tokens[middle:])


@functools.lru_cache(4)
def bpe(rank_file: str, pattern: str) -> Bpe:
    return Bpe(rank_file, pattern)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that a task holds little beside the batch that Spark hands over."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids): ids are little-endian unsigned 32-bit integers."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    part, leaf_schema = PART, f"id {id_type}, ids binary"

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(rank_file, pattern)
        for batch in slices(batches):
            ids = pa.array([packed(b.encode(t.as_py())) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), ids], names=[*(c for c in batch.schema.names if c != "text"), "ids"])

    out = rows.where(F.length("text") <= part).mapInArrow(leaves, leaf_schema)
    long = rows.where(F.length("text") > part)
    # Written, so that the numbers that tell rows apart stay if a task is run again.
    long = materialize(long.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    most = long.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return _counted(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                n = -(-len(text) // part)
                same = lambda c: pa.concat_arrays([batch.column(c).slice(k, 1)] * n)  # noqa: B023, E731
                texts = pa.array([text[no * part : (no + 1) * part] for no in range(n)])
                yield pa.RecordBatch.from_arrays([same("row"), pa.array(range(n), pa.int32()), same("id"), texts], names=["row", "no", "id", "text"])

    pieces = long.mapInArrow(cut, f"row long, no int, id {id_type}, text string")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = pieces.repartition(tasks, "row", "no").mapInArrow(leaves, f"row long, no int, {leaf_schema}")

    def joined(table: pa.Table) -> pa.Table:
        b = bpe(rank_file, pattern)
        table = table.sort_by("no")
        encoded = [unpacked(x) for x in table.column("ids").to_pylist()]
        while len(encoded) > 1:
            encoded = [b.join(*encoded[k : k + 2]) if k + 1 < len(encoded) else encoded[k] for k in range(0, len(encoded), 2)]
        first = table.slice(0, 1)
        up = pa.array([first.column("no")[0].as_py() // FAN], pa.int32())
        return pa.table([first.column("row"), up, first.column("id"), pa.array([packed(encoded[0])], pa.binary())], names=["row", "no", "id", "ids"])

    most = -(-most // part)
    while most > 1:
        made = made.groupBy("row", F.floor(F.col("no") / FAN).alias("up")).applyInArrow(joined, f"row long, no int, {leaf_schema}")
        most = -(-most // FAN)
    return _counted(out.unionByName(made.select("id", "ids")))


def _counted(encoded: DataFrame) -> DataFrame:
    return encoded.select("id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds a column decoded, the bytes of the tokens."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(rank_file, pattern)
        for batch in slices(batches):
            made = pa.array([b.decode(unpacked(x.as_py())) for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(texts, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary")
