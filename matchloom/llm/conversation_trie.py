"""Prefix trie of conversations: the nodes are distinct sequences of first turns, found by chained digests of prefixes.

Turns are numbered by ranges of (conversation, turn), so that a conversation of very many turns is no task's work. Digests are chained
in blocks of FAN turns: a block's inner chain doesn't depend on what stands before it, and the digests of whole blocks are a
conversation of their own, a FANth as long, whose prefixes are chained likewise. A prefix is its last whole block's digest and the
inner chain from there. Every prefix is exploded, and equal (depth, digest) are a node.

For sums over subtrees every node is exploded to its ancestors in its block and to itself. Where there are more turns than FAN, blocks'
sums go up a tree of blocks in the same way, and what stands below a block is added to the nodes inside it; so a node of depth d makes
some FAN rows for each level of blocks, not d.

Defined cases: rows without a conversation id take no part; null roles and texts are empty; turns of one number go by a digest of role
and text, null numbers first; repeated rows are turns of their own; a conversation without turns is a member of the root alone; an
empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

#: Turns of a block, and blocks of a block of the next level.
FAN = 16
#: Conversation ids that a row holds as text, at most.
CHUNK = 1024


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


ROOT = hashlib.sha256(b"").digest()


def numbered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, place, item, size): a turn's place in its conversation from 1, its digest, its text's bytes. Written.

    Rows are dealt to ranges and numbered within them as they pass; a conversation that goes over a range's end is numbered on by a
    row for each range.
    """
    spark = df.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    item = digest(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), item.alias("item"), F.octet_length(text).cast("long").alias("size"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("item"), F.monotonically_increasing_id()]  # equal rows may lie in several ranges
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("tie", order.pop()).repartitionByRange(n, *order, "tie").sortWithinPartitions(*order, "tie").select("conv", "item", "size")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, last, k = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for conv in batch.column("conv").to_pylist():
                k = k + 1 if conv == last else 1
                last = conv
                places.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array([at] * len(places), pa.int32())], names=[*batch.schema.names, "place", "range"])

    table = materialize(dealt.mapInArrow(count, "conv long, item binary, size long, place long, range int"), "turns")
    ends = table.groupBy("range").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "place")).alias("last")).orderBy("range").collect()  # a row for each range
    offsets, before, so_far = [], None, 0
    for r in ends:
        goes_on = before == r["first"]
        if goes_on:
            offsets.append((r["range"], r["first"], so_far))
        so_far = r["last"]["place"] + (so_far if goes_on and r["last"]["conv"] == before else 0)
        before = r["last"]["conv"]
    if not offsets:
        return table.drop("range")
    more = F.broadcast(spark.createDataFrame(offsets, "range int, conv long, more long"))
    return table.join(more, ["range", "conv"], "left").select("conv", (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), "item", "size")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation c begins with the first h turns of conversation c - c % group, h being crc32(c) % most, and goes on with its own
    after its first h. Returns turns (conv, place, item, size, n) and members (conv, n), n being the turns of a conversation."""
    c = F.col("conv")
    own = turns.groupBy("conv").agg(F.max("place").alias("own"))
    base = c - c % group
    head = F.when(c == base, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % most).cast("long")
    convs = own.select("conv", "own", base.alias("base"), head.alias("h"))
    lengths = own.where(c % group == 0).select(c.alias("base"), F.col("own").alias("base_own"))
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = materialize(convs.join(lengths, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    heads = turns.where((c % group == 0) & (F.col("place") < most)).withColumnRenamed("conv", "base")
    borrowed = convs.where("h > 0").join(heads, "base").where("place <= h").select("conv", "place", "item", "size", "n")
    rest = turns.join(convs, "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "item", "size", "n")
    return borrowed.unionByName(rest), convs.select("conv", "n")


def prefixes(items: DataFrame, most: int) -> list[DataFrame]:
    """items: (conv, place, item, …); most: the largest place. Of each level of blocks its prefixes (conv, place, key, ups, …): the
    prefix's digest, and those of its ancestors from the end of the block before on."""
    rest = [x for x in items.columns if x not in ("conv", "place")]
    block = F.floor((F.col("place") - 1) / FAN)
    blocks = items.groupBy("conv", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", *rest))).alias("xs"))  # FAN at most
    link = lambda done, x: F.concat(done, F.array(digest(F.element_at(done, -1), x["item"])))
    blocks = blocks.withColumn("inner", F.slice(F.aggregate("xs", F.array(F.lit(ROOT)), link), 2, FAN))
    above: list[DataFrame] = []
    root = F.lit(ROOT)
    if most > FAN:
        blocks = materialize(blocks, "blocks")
        above = prefixes(blocks.where(F.size("xs") == FAN).select("conv", (F.col("block") + 1).alias("place"), F.element_at("inner", -1).alias("item")), most // FAN)
        ends = above[0].select("conv", "place", F.col("key").alias("end"))
        blocks = blocks.join(ends.select("conv", F.col("place").alias("block"), F.col("end").alias("base")), ["conv", "block"], "left")
        blocks = blocks.join(ends.select("conv", (F.col("place") - 1).alias("block"), "end"), ["conv", "block"], "left")
        blocks = blocks.withColumn("base", F.coalesce("base", root))
    else:
        blocks = blocks.withColumn("base", root).withColumn("end", F.lit(None).cast("binary"))
    keys = F.transform("inner", lambda x, k: F.coalesce(F.when(k == FAN - 1, F.col("end")), digest(F.col("base"), x)))
    each = blocks.withColumn("keys", F.concat(F.array("base"), keys)).select("conv", "keys", F.posexplode("xs").alias("k", "x"))
    out = each.select("conv", "x.*", F.get("keys", F.col("k") + 1).alias("key"), F.slice("keys", 1, F.col("k") + 1).alias("ups")).drop("item")
    return [out, *above]


def _ends(members: DataFrame) -> DataFrame:
    """members: (key, conv). Of each key the digest of its ids as text, ascending and joined by commas. Ids come in chunks of text, and
    chunks of a key pass one after the other."""
    chunks = members.groupBy("key", F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, hashlib.sha256()
        out: list[tuple[bytes, str]] = []

        def made() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["key", "ends"])
            out.clear()
            return rows

        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == last:
                    h.update(b",")
                else:
                    if last is not None:
                        out.append((last, h.hexdigest()))
                    last, h = key, hashlib.sha256()
                h.update(ids.encode())
            yield made()
        if last is not None:
            out.append((last, h.hexdigest()))
        yield made()

    return chunks.repartition(n, "key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(hashed, "key binary, ends string")


def subtree_sums(nodes: DataFrame, above: list[DataFrame], values: list[str], most: int) -> DataFrame:
    """nodes: (key, place, ups, values). Of each key the values summed over its subtree, itself included."""
    top = F.col("place") % FAN == 0
    own = lambda key: F.struct(key.alias("key"), *values)
    # A block's last node is the first of the block below: its values go up with that.
    to = F.when(top, F.array(F.col("key"))).otherwise(F.concat("ups", F.array("key")))
    sums = [F.sum(v).alias(v) for v in values]
    inner = nodes.select(F.explode(F.transform(to, own)).alias("x")).select("x.*").groupBy("key").agg(*sums)
    if most < FAN:
        return inner
    inner = materialize(inner, "sums")
    if above:
        chains = above[0].groupBy("key").agg(F.min("place").alias("place"), F.first("ups").alias("ups"))
    else:  # the root and one block
        chains = nodes.where(top & (F.col("place") > 0)).select("key", F.lit(1).cast("long").alias("place"), F.array(F.lit(ROOT)).alias("ups"))
    tops = chains.unionByName(nodes.where("place = 0").select("key", "place", "ups")).join(inner, "key")
    whole = materialize(subtree_sums(tops, above[1:], values, most // FAN), "sums")
    below = nodes.where(top & (F.col("place") > 0)).select("key", "ups").join(whole, "key").select(F.explode(F.transform(F.slice("ups", 2, FAN), own)).alias("x")).select("x.*")
    return inner.join(whole, "key", "left_anti").unionByName(below).groupBy("key").agg(*sums).unionByName(whole.select("key", *values))


def nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """turns: (conv, place, item, size, n); members: (conv, n), conversations without turns as well. A row for each node: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key."""
    most = members.agg(F.max("n")).first()[0]
    levels = prefixes(turns, most or 1)
    rows = materialize(levels[0], "prefixes")
    root = F.lit(ROOT)
    made = rows.groupBy("place", "key").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n").alias("deepest"), F.first("ups").alias("ups"), F.min("size").alias("size"))
    start = members.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n").alias("deepest")).where("n_convs > 0")
    start = start.select(F.lit(0).cast("long").alias("place"), root.alias("key"), "conv_id", "n_convs", "deepest", F.array().cast("array<binary>").alias("ups"), F.lit(0).cast("long").alias("size"))
    ends = _ends(rows.where("place = n").select("key", "conv").unionByName(members.where("n = 0").select(root.alias("key"), "conv")))
    made = made.unionByName(start).join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())))
    leaf, saved = (F.col("deepest") == F.col("place")).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    made = materialize(made.select("key", "place", "ups", "conv_id", "n_convs", "ends", leaf.alias("n_leaves"), saved.alias("saved_tokens")), "nodes")
    drop(rows)
    parent = F.element_at("ups", -1)
    sums = subtree_sums(made.select("key", "place", "ups", "n_leaves", "saved_tokens"), levels[1:], ["n_leaves", "saved_tokens"], most or 0)
    children = made.where("place > 0").groupBy(parent.alias("key")).agg(F.count("*").alias("n_children"))
    parents = made.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = made.select("key", "place", "conv_id", "n_convs", "ends", F.when(F.col("place") > 0, parent).alias("parent"))
    out = out.join(sums, "key").join(children, "key", "left").join(parents, "parent", "left")
    return out.select(
        "conv_id", F.col("place").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"), "key",
    )
