"""The wide part of operator 7: near copies by the Jaccard similarity of five-word shingle sets, at 0.8 or more, checked exactly.

Fingerprints at such a similarity differ in 4 to 14 bits of 64 (sf0.1), and a grid range join of that radius lets nearly all
pairs through: SimHash alone can't find them. So its links, found on the grid at 2 bits, come first and join
what is nearly equal, each checked on shingle sets; further candidates come from MinHash: 20 bands of 4 values, which put
a pair at similarity 0.8 into a common bucket but for 3 in 100,000, and one at 0.9 but for 3 in 10 billion.
Every candidate pair is then either found connected already, ruled out by a bound, or compared on its whole shingle sets, so
that no bucket is sampled or cut. So as not to form the pairs of a large group, each text is first held against
two leaders that it shares a bucket with, one of them the group's most typical text, and contraction joins what agrees. Of the texts whose buckets then still lie in
different components, those with too many shingles that no other open text has can't have a link (see ``_hopeful``);
what is left is compared pair by pair, as far as sizes and shared shingles allow.

Texts with equal shingle sets are one node, so a mass of exact copies costs as much as one text.

Defined cases: words are ASCII-lower-cased and split at white space; a text of fewer words than a shingle is one shingle; null
and blank texts have the empty set and are copies of each other; a null id never names a component unless it has no other; repeated
rows leave one row; an empty table gives an empty result; all columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import drop, materialize
from .simhash import _hash, contract

SHINGLE, BANDS, ROWS = 5, 20, 4
#: Similarity of LEAST[0] / LEAST[1] or more links two texts.
LEAST = (4, 5)
#: Leaders are picked among nodes of like size, classes of which go up by this factor.
SIZES = 1.2
#: Shingles taken through all hash functions at once; bounds the memory that a very long text takes.
CHUNK = 1 << 14
_MIX = np.random.default_rng(20).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    w = (text or "").encode().lower().split()
    if len(w) < shingle:
        return np.array([_hash(b" ".join(w))] if w else [], np.uint64)
    n = len(w) - shingle + 1
    return np.unique(np.fromiter(map(_hash, map(b" ".join, zip(*(w[k:] for k in range(shingle))))), np.uint64, n))


def buckets(grams: np.ndarray) -> list[int]:
    """A signed hash of each band of MinHash values; none of an empty set, whose equals are one node anyway."""
    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), CHUNK):
        mixed = (grams[None, at : at + CHUNK] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(1))
    rows = least.reshape(BANDS, ROWS)
    return [signed(xxhash.xxh64_intdigest(rows[k].tobytes(), seed=k)) for k in range(BANDS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"), F.col(text_col).cast("string").alias("text"))


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row per document: id, body (a hash of the text), node (a hash of its shingle set), n (shingles), fp (the set's SimHash),
    buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, fps, keys = [], [], [], []
            for t in b.column(2):
                g = shingles(t.as_py(), shingle)
                node.append(signed(_hash(g.tobytes())))
                n.append(len(g))
                fps.append(signed(simhash.majority((g[i : i + CHUNK] for i in range(0, len(g), CHUNK)), len(g))))
                keys.append(buckets(g))
            columns = [pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["id", "body", "node", "n", "fp", "buckets"])

    slim = _slim(docs, id_col, text_col)
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, body long, node long, n long, fp long, buckets array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, grams) of the wanted nodes, taken from the text of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, t in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([shingles(t.as_py(), shingle).view(np.int64)], pa.list_(pa.int64()))], ["node", "grams"])

    s, w = _slim(docs, id_col, text_col).alias("s"), wanted.alias("w")
    texts = s.join(w, F.col("s.id").eqNullSafe(F.col("w.id")) & (F.col("s.body") == F.col("w.body"))).select("w.node", "s.text")
    return texts.mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"])


def _alike(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Of the pairs (a, b) those of that similarity or more."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    shared, (up, down) = F.size(F.array_intersect("x", "y")), similarity
    return both.where(shared * (up + down) >= up * (F.size("x") + F.size("y"))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _own(sets: DataFrame) -> DataFrame:
    """(node, own) of the nodes that have shingles no other has: how many."""
    tokens = sets.select("node", F.explode("grams").alias("g"))
    return tokens.groupBy("g").agg(F.count("*").alias("held"), F.min("node").alias("node")).where("held = 1").groupBy("node").agg(F.count("*").alias("own"))


def _open(rows: DataFrame) -> DataFrame:
    """The rows (bucket, root, …) of buckets with nodes of different components."""
    by = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    return rows.join(by, "bucket", "left_semi")


def _hopeful(left: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Rows (bucket, node, n, root) of the nodes that can still have a link in the bucket, with shared: how many of a node's
    shingles another open node has as well. Two linked texts share up / (up + down) of their sizes added up, and up / down of
    either, at least; a node that shares less than that with a text as short as the bucket's shortest has no link there."""
    up, down = similarity
    own = _own(sets.join(left.select("node").distinct(), "node", "left_semi"))
    counted = left.join(own, "node", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    counted = counted.where(F.col("shared") * down >= F.col("n") * up)
    least = counted.groupBy("bucket").agg(F.min("n").alias("least"))
    return counted.join(least, "bucket").where(F.col("shared") * (up + down) >= (F.col("n") + F.col("least")) * up).drop("least")


def links(near: DataFrame, sets: DataFrame, first: DataFrame, similarity: tuple[int, int] = LEAST) -> DataFrame:
    """(node, root) of the nodes with a link; near has (bucket, node, n), a row per node in a shared bucket, and first the pairs
    (a, b) to begin with."""
    leaders = materialize(_leaders(near, sets), "near-leaders")
    to_leaders = leaders.select(F.col("node").alias("a"), F.explode(F.array("lead", "other")).alias("b")).where("a <> b")
    tested = materialize(_ordered(first.unionByName(to_leaders)), "near-pairs")
    stars = contract(materialize(_alike(tested, sets, similarity), "near-links"))
    placed = near.join(stars, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    left = materialize(_open(placed), "near-open")
    left = materialize(_open(materialize(_hopeful(left, sets, similarity), "near-hopeful")), "near-open")
    pairs = _ordered(_possible(left, leaders, sets, similarity))
    pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
    found = materialize(_alike(pairs, sets, similarity), "near-links")
    if found.isEmpty():
        return stars
    # What is known goes on as its stars.
    return contract(materialize(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found).distinct(), "near-edges"))


def _possible(left: DataFrame, leaders: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of open nodes of a bucket that can be linked, found without pairing what can't.

    Two nodes with one leader share no more than the lesser of what each shares with it, unless they share a shingle that
    the leader lacks. So of those only pairs with enough in common with the leader meet, or pairs with such a shingle, which are
    few: copies with edits of their own have hardly any in common. Nodes of unlike leaders meet in their buckets."""
    up, down = similarity
    alike_n = (F.col("p.n") * down >= F.col("q.n") * up) & (F.col("q.n") * down >= F.col("p.n") * up)
    apart = (F.col("p.node") > F.col("q.node")) & (F.col("p.root") != F.col("q.root")) & alike_n
    enough = lambda c: F.least(f"p.{c}", f"q.{c}") * (up + down) >= up * (F.col("p.n") + F.col("q.n"))
    rows = left.join(leaders.select("node", "lead"), "node")
    nodes = rows.select("node", "n", "root", "lead").distinct().join(sets, "node")
    held = sets.select(F.col("node").alias("lead"), F.col("grams").alias("led"))
    outside = F.array_except("grams", "led")
    nodes = materialize(nodes.join(held, "lead").select("node", "n", "root", "lead", outside.alias("outside")).withColumn("inside", F.col("n") - F.size("outside")), "near-nodes")

    def met(df: DataFrame, by: list[str], condition) -> DataFrame:
        same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in by]
        joined = df.alias("p").join(df.alias("q"), reduce(lambda x, y: x & y, [*same, apart, condition]))
        return joined.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))

    unlike = met(rows, ["bucket"], enough("shared") & (F.col("p.lead") != F.col("q.lead")))
    # Too little inside for any text that is long enough: out before they meet.
    inside = nodes.where(F.col("inside") * (up + down) * down >= (F.col("n") * down + F.col("n") * up) * up).withColumnRenamed("lead", "bucket").drop("outside")
    near_leader = met(_open(inside), ["bucket"], enough("inside"))
    tokens = nodes.select("node", "n", "root", "lead", F.explode("outside").alias("g"))
    shared = tokens.groupBy("lead", "g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("lead", "g")
    beside = met(tokens.join(shared, ["lead", "g"], "left_semi"), ["lead", "g"], F.lit(True))
    return unlike.unionByName(near_leader).unionByName(beside)


def _leaders(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, lead, other): for each node two nodes of its size that it shares a bucket with: the most typical one, which has the
    smallest share of shingles that no other node has (the larger of equals) and so is nearest to the text that a group's copies
    were made from, and the one of the smallest hash."""
    own = F.coalesce(F.col("own"), F.lit(0)) / F.col("n")
    kind = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZES))).cast("int")
    by = {"a": F.struct(own.alias("own"), (-F.col("n")).alias("less"), F.col("node").alias("at")), "b": F.struct(F.col("node").alias("at"))}
    rows = near.join(_own(sets), "node", "left").select("bucket", "node", kind.alias("kind"), *[x.alias(k) for k, x in by.items()])
    leads = rows.groupBy("bucket", "kind").agg(F.min("a").alias("lead_a"), F.min("b").alias("lead_b"))
    each = rows.join(leads, ["bucket", "kind"]).groupBy("node").agg(F.min("lead_a").alias("lead_a"), F.min("lead_b").alias("lead_b"))
    return each.select("node", F.col("lead_a.at").alias("lead"), F.col("lead_b.at").alias("other"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = LEAST) -> DataFrame:
    """A row per document: id, body, root (a node of its component), component_id (its smallest id). MinHash's bands are made for
    similarities from about 0.8 on."""
    seen = materialize(prints(docs, id_col, text_col, shingle), "near-prints")
    best = F.min(F.struct("body", "id")).alias("one")
    distinct = seen.groupBy("node").agg(F.min("id").alias("least"), best, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets"))
    distinct = materialize(distinct, "near-distinct")
    rows = distinct.select("node", "n", F.explode("buckets").alias("bucket"))
    busy = materialize(rows.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1").select("bucket"), "near-buckets")
    near = materialize(rows.join(busy, "bucket", "left_semi").select("bucket", "node", "n"), "near-members")
    drop(busy)
    first = materialize(_by_fingerprint(distinct), "near-first")
    known = near.select("node").union(first.select("a")).union(first.select("b")).distinct()
    wanted = distinct.join(known, "node", "left_semi").select("node", "one.id", "one.body")
    sets = materialize(_sets(docs, wanted, id_col, text_col, shingle), "near-sets")
    stars = links(near, sets, first, similarity)
    rooted = materialize(distinct.join(stars, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "near-rooted")
    drop(sets)
    drop(near)
    names = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "near-names")
    table = materialize(rooted.join(names, "root").select("node", "root", "component_id"), "near-components")
    return seen.join(table, "node").select("id", "body", "root", "component_id")


def _by_fingerprint(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by SimHash: nodes of one fingerprint with the least of them, and the least of linked fingerprints."""
    least = materialize(distinct.groupBy("fp").agg(F.min("node").alias("node")), "near-fingerprints")
    same = distinct.join(least.withColumnRenamed("node", "b"), "fp").select(F.col("node").alias("a"), "b").where("a <> b")
    edges = simhash.links(least.select("fp"))
    named = edges.join(least.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    return same.unionByName(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
