"""Vector code compression: product codes by Lloyd's rounds that rescan only what drift may have moved.

Vectors are cut into equal consecutive parts, and each part position has a codebook of its own. A task holds vectors in blocks. In
a block every codebook entry has a heap of the parts it holds, keyed by slack: the distance to the second nearest entry less the
distance to its own. When entries move, a part's slack shrinks by no more than its own entry's drift plus the largest drift among
the others. These are added up for each entry, so that a key is the slack plus the drift so far when the part was pushed, and the
parts whose bounds the drift has violated are those at the heap's top: they are popped, held exactly against all entries and pushed
where they belong now. All others keep their entries without being looked at.

A round is one pass over a table of blocks: it writes the blocks with their heaps anew and, for each task, what entries gained and
lost in parts and sums. The driver gets one row for each entry and component. Distances are whole numbers and exact; bounds are
rounded to the safe side, so that a tie, which goes to the lower entry, is always rescanned.

Defined cases: vectors that are null or hold null or non-finite components are dropped; a null id is kept but comes last when first
entries are chosen; of equal ids the smaller vector comes first; repeated rows are coded each; null labels are one label; fewer
vectors than entries make fewer entries; an empty table gives no rows; other columns are ignored. Vectors of unlike lengths, a
length that the parts don't divide, and components too large for a distance in 64 bits raise ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, small

#: Components become floor(SCALE * x).
SCALE = 1024
#: Components of a block's vectors in all.
BLOCK = 1 << 19
#: Cells of a distance table that are computed at once.
CELLS = 1 << 20
#: Relative allowance for rounding in bounds.
SAFE = 2.0**-40
#: Labels up to which their errors are sent to every task.
BROADCAST_LABELS = 10_000


@dataclass
class Books:
    """Codebooks (part, entry, component), and the drift of each entry and its strongest rival so far."""

    entries: np.ndarray
    drift: np.ndarray = field(init=False)

    def __post_init__(self):
        self.drift = np.zeros(self.entries.shape[:2])

    def move(self, counts: np.ndarray, sums: np.ndarray) -> None:
        """Entries become the floored means of their parts; unused ones stay."""
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries)
        moved = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + SAFE)
        if moved.shape[1] > 1:
            top = np.sort(moved, axis=1)
            rival = np.where(moved == top[:, -1:], np.where(top[:, -1:] == top[:, -2:-1], top[:, -1:], top[:, -2:-1]), top[:, -1:])
        else:
            rival = np.zeros_like(moved)
        self.entries, self.drift = new, (self.drift + moved + rival) * (1 + SAFE)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts from entries, exact: in floating point as long as all steps are whole numbers below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part its nearest entry, the lower of equals, and its slack, rounded down."""
    held, slack = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, CELLS // max(1, len(entries)))
    for a in range(0, len(x), step):
        d = distances(x[a : a + step], entries)
        best = d.argmin(1)
        rows = np.arange(len(d))
        own = np.sqrt(d[rows, best].astype(np.float64))
        if len(entries) > 1:
            d[rows, best] = np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf
            second = np.sqrt(d.min(1).astype(np.float64))
            slack[a : a + step] = second - own - (second + own) * SAFE
        else:
            slack[a : a + step] = np.inf
        held[a : a + step] = best
    return held, slack


@dataclass
class Block:
    """Vectors of a task, the entries that hold their parts, and the heaps: of each (part, entry) the parts' keys and rows."""

    values: np.ndarray  # vector, part, component
    held: np.ndarray  # part, vector
    keys: list[list[np.ndarray]]
    rows: list[list[np.ndarray]]

    @classmethod
    def fresh(cls, values: np.ndarray, books: Books) -> "Block":
        n, parts, _ = values.shape
        entries = books.entries.shape[1]
        out = cls(values, np.empty((parts, n), np.int64), [], [])
        for p in range(parts):
            held, slack = nearest(values[:, p], books.entries[p])
            out.held[p] = held
            key = keyed(slack, books.drift[p][held])
            order = np.lexsort((key, held))  # ascending keys are a heap
            cuts = np.searchsorted(held[order], np.arange(1, entries))
            out.keys.append(np.split(key[order], cuts))
            out.rows.append(np.split(order, cuts))
        return out

    def rescan(self, books: Books) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pops what the drift has violated and pushes it where it belongs. Of each part position: rows, entries before and after."""
        out = []
        for p, (keys, rows) in enumerate(zip(self.keys, self.rows)):
            heaps: dict[int, list[tuple[float, int]]] = {}
            popped: list[int] = []

            def heap(e: int) -> list[tuple[float, int]]:
                if e not in heaps:
                    heaps[e] = list(zip(keys[e].tolist(), rows[e].tolist()))
                return heaps[e]

            for e in range(len(keys)):
                drift = books.drift[p, e]
                if len(keys[e]) and keys[e][0] <= drift:
                    h = heap(e)
                    while h and h[0][0] <= drift:
                        popped.append(heapq.heappop(h)[1])
            at = np.array(popped, np.int64)
            before = self.held[p][at]
            after, slack = nearest(self.values[at, p], books.entries[p])
            for row, e, key in zip(popped, after.tolist(), keyed(slack, books.drift[p][after]).tolist()):
                heapq.heappush(heap(e), (key, row))
            for e, h in heaps.items():
                keys[e], rows[e] = np.array([k for k, _ in h]), np.array([r for _, r in h], np.int64)
            self.held[p][at] = after
            out.append((at, before, after))
        return out

    def error(self, books: Books) -> np.ndarray:
        total = np.zeros(len(self.values), np.int64)
        for p in range(len(self.held)):
            d = self.values[:, p].astype(np.int64) - books.entries[p][self.held[p]]
            total += (d * d).sum(1)
        return total

    # A block in a row of a table: whole numbers as narrow as they fit.

    def packed(self) -> tuple[bytes, int, bytes, bytes, bytes, bytes]:
        v = narrow(self.values)
        sizes = np.array([[len(k) for k in ks] for ks in self.keys], np.int32)
        keys, rows = (np.concatenate([x for xs in z for x in xs]) for z in (self.keys, self.rows))
        return v.tobytes(), v.dtype.itemsize, self.held.astype(np.int32).tobytes(), sizes.tobytes(), keys.tobytes(), rows.astype(np.int32).tobytes()

    @classmethod
    def unpacked(cls, shape: tuple[int, int, int], values: bytes, width: int, held: bytes, sizes: bytes, keys: bytes, rows: bytes) -> "Block":
        n, parts, _ = shape
        bounds = np.frombuffer(sizes, np.int32).reshape(parts, -1)
        cuts = np.cumsum(bounds.ravel())[:-1]
        k = np.split(np.frombuffer(keys, np.float64), cuts)
        r = np.split(np.frombuffer(rows, np.int32).astype(np.int64), cuts)
        by_part = lambda xs: [xs[p * bounds.shape[1] : (p + 1) * bounds.shape[1]] for p in range(parts)]
        return cls(np.frombuffer(values, f"i{width}").reshape(shape), np.frombuffer(held, np.int32).reshape(parts, n).astype(np.int64), by_part(k), by_part(r))


def keyed(slack: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """The heap's key: while it is above the drift, no other entry can be as near. Rounded down."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isinf(slack), np.inf, slack + drift - (np.abs(slack) + drift) * SAFE)


def narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


class Tally:
    """What entries gained and lost: counts and sums of parts."""

    def __init__(self, shape: tuple[int, int, int]):
        self.counts, self.sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)

    def add(self, p: int, entries: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
        if not len(entries):
            return
        order = np.argsort(entries, kind="stable")
        e = entries[order]
        starts = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
        self.counts[p, e[starts]] += sign * np.diff(np.r_[starts, len(e)])
        self.sums[p, e[starts]] += sign * np.add.reduceat(x[order].astype(np.int64), starts, axis=0)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as whole numbers."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if np.abs(scaled).max(initial=0) * 2 * max(1, vectors.shape[1]) ** 0.5 >= 2**31:
        raise ValueError("components are too large for squared distances in 64 bits")
    return scaled.astype(np.int64)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width or np.any(np.diff(column.offsets.to_numpy()) != width):
        raise ValueError(f"vectors of unlike lengths: not all have {width} components")
    return flat.reshape(len(column), width)


BLOCK_FIELDS = ("values", "width", "held", "sizes", "keys", "rows")


def _first_pass(batches: Iterator[pa.RecordBatch], books: Books, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    parts, _, d = books.entries.shape
    tally = Tally(books.entries.shape)
    size = max(1, BLOCK // max(1, parts * d))
    for whole_batch in batches:
        for a in range(0, whole_batch.num_rows, size):
            batch = whole_batch.slice(a, size)
            block = Block.fresh(whole(matrix(batch.column("v"), parts * d)).reshape(batch.num_rows, parts, d), books)
            for p in range(parts):
                tally.add(p, block.held[p], block.values[:, p])
            yield _row(block, batch.column("id"), batch.column("label"), schema)
    yield from _tallied(tally, schema)


def _next_pass(batches: Iterator[pa.RecordBatch], books: Books, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    tally = Tally(books.entries.shape)
    for batch in batches:
        for k in range(batch.num_rows):
            block = _block(batch, k, books)
            for p, (at, before, after) in enumerate(block.rescan(books)):
                changed = before != after
                x = block.values[at[changed], p]
                tally.add(p, before[changed], x, -1)
                tally.add(p, after[changed], x)
            yield _row(block, batch.column("ids")[k].values, batch.column("labels")[k].values, schema)
    yield from _tallied(tally, schema)


def _last_pass(batches: Iterator[pa.RecordBatch], books: Books, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            block = _block(batch, k, books)
            block.rescan(books)
            ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
            codes = pa.array(block.held.T.astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([ids.cast(schema.field(0).type), labels.cast(schema.field(1).type), codes, pa.array(block.error(books))], schema=schema)


def _block(batch: pa.RecordBatch, k: int, books: Books) -> Block:
    parts, _, d = books.entries.shape
    return Block.unpacked((len(batch.column("ids")[k].values), parts, d), *[batch.column(f)[k].as_py() for f in BLOCK_FIELDS])


def _row(block: Block, ids: pa.Array, labels: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    values = dict(zip(BLOCK_FIELDS, block.packed()))
    lists = {"ids": ids, "labels": labels}
    arrays = [
        pa.ListArray.from_arrays(pa.array([0, len(lists[f.name])], pa.int32()), lists[f.name]).cast(f.type) if f.name in lists else pa.array([values.get(f.name)], f.type)
        for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _tallied(tally: Tally, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each entry that gained or lost: its count, then its sums."""
    part, entry = np.nonzero((tally.counts != 0) | tally.sums.any(2))
    if len(part):
        totals = np.concatenate([tally.counts[part, entry][:, None], tally.sums[part, entry]], axis=1)
        columns = {"part": part, "entry": entry, "totals": totals.tolist()}
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(part), f.type) for f in schema], schema=schema)


def _gained(state: DataFrame, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums that all tasks together gained or lost: a row for each entry and component comes to the driver."""
    cells = state.where(F.col("part").isNotNull()).select("part", "entry", F.posexplode("totals").alias("k", "v")).groupBy("part", "entry", "k").agg(F.sum("v").alias("v"))
    parts, entries, d = books.entries.shape
    out = np.zeros((parts, entries, d + 1), np.int64)
    got = cells.toArrow()
    out[tuple(got.column(c).to_numpy() for c in ("part", "entry", "k"))] = got.column("v").to_numpy()
    return out[:, :, 0], out[:, :, 1:]


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Books | None]:
    """Rows (id, label, codes, error), codes being the entry of each part and error the squared distance from them, and the final codebooks.

    First entries are the parts of the vectors of the smallest ids. Runs rounds + 1 passes; the codebooks' size is set by the
    parameters, so the tasks and the driver hold them whole.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(fine(x), F.lit(False))))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long"
    first = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]  # as many as a codebook has entries
    if not first:
        return df.sparkSession.createDataFrame([], schema), None
    width = len(first[0])
    if width % parts or any(len(x) != width for x in first):
        raise ValueError(f"vectors of unlike lengths, or of lengths that {parts} parts don't divide: {sorted({len(x) for x in first})}")
    books = Books(whole(np.array(first, np.float64).reshape(len(first), width)).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy())
    state_schema = f"part int, entry int, totals array<bigint>, ids array<{kinds['id']}>, labels array<{kinds['label']}>, values binary, width int, held binary, sizes binary, keys binary, rows binary"
    counts, sums = np.zeros(books.entries.shape[:2], np.int64), np.zeros(books.entries.shape, np.int64)
    state: DataFrame | None = None
    for _ in range(rounds):
        made = _passed(rows if state is None else state, _first_pass if state is None else _next_pass, books, state_schema)
        made, old = materialize(made, "vector-blocks"), state
        if old is not None:
            drop(old)
        state = made.where(F.col("ids").isNotNull())
        gained = _gained(made, books)
        counts, sums = counts + gained[0], sums + gained[1]
        books.move(counts, sums)
    if state is None:
        state = _passed(rows, _first_pass, books, state_schema).where(F.col("ids").isNotNull())
    return _passed(state, _last_pass, books, schema), books


def _passed(rows: DataFrame, step, books: Books, schema: str) -> DataFrame:
    import copy

    held = copy.deepcopy(books)
    arrow = _arrow(rows, schema)
    return rows.mapInArrow(lambda batches: step(batches, held, arrow), schema)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels, nulls together: labels are summed first and joined back, so that no label gathers."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return coded.join(small(sums, BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def code_string(codes) -> F.Column:
    """Codes in hex digits, two of each part."""
    return F.array_join(F.transform(codes, lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))), "")
