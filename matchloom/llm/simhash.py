"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 16 segments of 4 bits. The Manhattan distance of two such vectors
is at most the Hamming distance of the fingerprints, so fingerprints at 2 or fewer differing bits lie within 2 of each
other on the grid. That range join becomes an equality join: two grid points within distance 2 share a point that is
within 1 of both, so each fingerprint is entered at its own point and at its (at most 32) neighbours. Fingerprints that
meet in a cell are the candidates; each candidate is checked exactly, by the bits in which the two differ.

A cell of more than CELL fingerprints, as a large group of near copies makes, would have too many pairs. It is split further: each
of its fingerprints is entered under every bit pattern that realises the cell's step (4 at most), and those under one
pattern, 65 at most, link to the smallest of them. Those links differ in 2 bits at most as well, and connect whatever the
cell's pairs would. So no link is lost, and the work grows in proportion to the distinct fingerprints.

Components follow from alternating star contraction. ``one_per_component`` with a similarity asks for more than fingerprints
can tell (see ``near_copies``): there the links found here are checked on the texts' shingle sets and others join them.

Defined cases: a null or blank text has fingerprint zero and links like any other; rows with equal fingerprints are
linked; a null id never becomes a component's name unless the component has no other; repeated rows keep a row each in
``components`` and leave one in ``one_per_component``, rows equal in id and text the first by all columns; an empty table
gives an empty result; extra columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import drop, fresh, materialize

SEGMENTS, WIDTH, SHINGLE = 16, 4, 3
_hash = partial(xxhash.xxh64_intdigest, seed=42)
#: Shingles whose bits are counted at once; bounds the memory that a very long text takes.
CHUNK = 1 << 16
#: Fingerprints of a grid cell up to which they are compared one by one.
CELL = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Of the hashes of all shingles of ASCII-lower-cased words: the bits set in over half."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) < shingle:
        grams, n = iter([b" ".join(w)]), 1
    else:
        grams, n = map(b" ".join, zip(*(w[k:] for k in range(shingle)))), len(w) - shingle + 1
    hashes = map(_hash, grams)
    return majority((np.fromiter(hashes, np.uint64, min(n - at, CHUNK)) for at in range(0, n, CHUNK)), n)


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """The bits set in over half of n hashes, which come in parts."""
    counts = np.zeros(64, np.int64)
    for part in parts:
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row per document: id, fp (signed 64 bits), body (a hash of the text, to find the row again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in map(lambda x: x.as_py(), b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], ["id", "fp", "body"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, fp long, body long")


def _bits(fp: Column, seg: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, seg * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))).cast("long")


def _cells(distinct: DataFrame) -> DataFrame:
    """(fp, step, cell): step 0 at the own grid point, 1 to 16 one up in a segment, 17 to 32 one down."""
    base = WIDTH + 1
    counted = distinct.select("fp", *[_bits(F.col("fp"), k).alias(f"p{k}") for k in range(SEGMENTS)])
    at = sum((F.col(f"p{k}") * F.lit(base**k) for k in range(SEGMENTS)), F.lit(0).cast("long"))
    put = counted.withColumn("at", at)
    up = [F.when(F.col(f"p{k}") < WIDTH, F.col("at") + F.lit(base**k)) for k in range(SEGMENTS)]
    down = [F.when(F.col(f"p{k}") > 0, F.col("at") - F.lit(base**k)) for k in range(SEGMENTS)]
    return put.select("fp", F.posexplode(F.array(F.col("at"), *up, *down)).alias("step", "cell")).where(F.col("cell").isNotNull())


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, over distinct fingerprints, each of 2 differing bits at most: all of them that meet in cells of up to
    CELL fingerprints, and in larger ones star edges that connect the same."""
    # So many rows to a fingerprint that a few tasks of the scan would be long ones.
    n_tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _cells(distinct.repartition(n_tasks))
    up = F.sum(F.when((F.col("step") > 0) & (F.col("step") <= SEGMENTS), 1).otherwise(0))
    busy = rows.groupBy("cell").agg(up.alias("up"), F.count("*").alias("n")).where((F.col("up") > 0) & (F.col("n") > 1)).select("cell", (F.col("n") > CELL).alias("hot"))
    busy = materialize(busy, "simhash-cells")
    near = materialize(rows.join(busy, "cell"), "simhash-near")
    met = near.where("NOT hot").groupBy("cell").agg(F.sort_array(F.collect_set("fp")).alias("all"))  # CELL at most
    pairs = met.select(F.posexplode("all").alias("i", "b"), "all").select("b", F.explode(F.slice("all", F.col("i") + 2, CELL)).alias("a"))
    checked = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    edges = materialize(checked.unionByName(_stars(near.where("hot"))).distinct(), "simhash-links")
    drop(near)
    drop(busy)
    return edges


def _stars(near: DataFrame) -> DataFrame:
    """Star edges within hot cells: under each shared pattern all link to the smallest."""
    one = lambda k: F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")
    seg = F.pmod(F.col("step") - 1, F.lit(SEGMENTS))
    flips = []
    for k in range(SEGMENTS * WIDTH):
        is_set = F.col("fp").bitwiseAND(one(k)) != 0
        wanted = F.when(F.col("step") <= SEGMENTS, ~is_set).otherwise(is_set)
        flips.append((k, F.when((F.col("step") > 0) & wanted, F.col("fp").bitwiseXOR(one(k)))))
    by_segment = F.coalesce(*[F.when(seg == s, F.array(*[f for k, f in flips if k // WIDTH == s])) for s in range(SEGMENTS)])
    patterns = F.when(F.col("step") == 0, F.array("fp")).otherwise(by_segment)
    entered = near.select("fp", F.explode(patterns).alias("pattern")).where(F.col("pattern").isNotNull())
    least = F.min("fp")
    group = entered.groupBy("pattern").agg(F.collect_set("fp").alias("all"), least.alias("b")).where(F.size("all") > 1)  # at most 65
    stars = group.select(F.explode("all").alias("a"), "b").where("a <> b")
    return stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge, root the smallest reachable. Edges are (a, b) with a > b.

    Large-star and small-star in turn until nothing changes; smallest neighbours are taken with partial aggregation
    and written out before they are joined back, so that a hub's rows are split by the adaptive skew join.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def step(df: DataFrame, label: str) -> DataFrame:
        return materialize(df.where("a <> b").distinct(), label)

    now, seen = edges, state(edges)
    while seen[0]:
        before = now
        both = before.union(before.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
        large = step(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")), "star")
        drop(least)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "star")
        joined = large.join(least, "a")
        now = step(joined.select("b", "m").toDF("a", "b").union(least.select("a", "m").toDF("a", "b")), "star")
        drop(least)
        drop(large)
        if before is not edges:
            drop(before)
        was, seen = seen, state(now)
        if was == seen:
            break
    return now.toDF("node", "root")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row per document: id, body, fp, root (the component's smallest fingerprint), component_id (its smallest id)."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    edges = links(distinct.select("fp"))
    stars = contract(edges)
    rooted = distinct.join(stars, distinct.fp == stars.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-rooted")
    drop(distinct)
    drop(edges)
    names = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    table = materialize(rooted.join(names, "root").select("fp", "root", "component_id"), "simhash-components")
    drop(rooted)
    drop(names)
    return prints.join(table, "fp").select("id", "body", "fp", "root", "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] | None = None) -> DataFrame:
    """The row with the smallest id of every component, all its columns kept. Components are those of ``components``, or with a
    similarity (a fraction) those of texts whose shingle sets are that similar."""
    if similarity is None:
        return first_of_each(docs, components(docs, id_col, text_col, shingle), id_col, text_col)
    from . import near_copies

    return first_of_each(docs, near_copies.components(docs, id_col, text_col, shingle, similarity), id_col, text_col)


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same for components found before: a row per document with id, body, root and component_id. Of rows equal in id and
    text the least by a hash of all columns stays."""
    body = fresh(docs, "body_hash")
    first = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("body").alias("body"), F.min("id").alias("id"))
    first = materialize(first, "simhash-first").alias("f")
    marked = docs.withColumn(body, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("d")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("f.id")) & (F.col(f"d.`{body}`") == F.col("f.body"))
    kept = marked.join(first, same, "left_semi")
    # Of rows that agree in both the least is picked while they are combined, so that however many there are they never gather.
    order = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = kept.groupBy(F.col(f"`{id_col}`").alias("k"), F.col(f"`{body}`").alias("h")).agg(F.min_by(row, order).alias("row"))
    return least.select(*[F.col("row")[c].alias(c) for c in docs.columns])
