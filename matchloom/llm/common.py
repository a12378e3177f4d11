"""Shared helpers: word patterns, the folder all executors share, tables that cut lineage."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder, spread

#: Separators of "terms": anything but ASCII digits, ASCII letters in lower case and non-ASCII characters.
TERM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Separators of "words": ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; a null text is empty. In an ASCII text, where the two agree, lower() is faster."""
    full = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(full) == F.length(full), F.lower(full)).otherwise(F.translate(full, UPPER, LOWER))


def terms(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), TERM_GAP), "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes the frame to the shared folder and reads it back: lineage ends there, and the copy outlives executors."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote, once nothing needs it."""
    spark = df.sparkSession
    for file in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranged_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """The frame with, for each name, the sum of its column over all rows before in that order, which must be total.

    Rows are dealt to ranges, each range is summed, the sums of earlier ranges are added up over a row per range, and windows go
    over one range each: nothing gathers all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written out, so that a range stays the same range when a task is run again.
    dealt = materialize(df.withColumns(sums).repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    total = dealt.groupBy("__range").agg(*[F.sum(k).alias(k) for k in sums])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    bases = total.select("__range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumns({k: F.coalesce(F.sum(k).over(within), F.lit(0)) for k in sums})
    return inner.join(F.broadcast(bases), "__range").withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__range", *[f"__{k}" for k in sums])


#: Bytes of a shard: a 256th of the whole, within these bounds.
LEAST_SHARD, MOST_SHARD = 16 << 20, 1 << 30


def shard_size(total: int) -> int:
    """Bytes of a shard, by the data alone, so that a table makes the same shards on any cluster."""
    return min(MOST_SHARD, max(LEAST_SHARD, total >> 8))


class Cuts:
    """Shards of rows in the order of their ids (nulls first), cut at fixed marks of their bytes added up in that order.

    keys has id, spot (a hash that tells the rows of an id apart) and bytes. An id with more bytes than a shard is divided by
    spot into parts of their own; rows equal in both stay together. The driver gets a row per shard and per such id.
    """

    def __init__(self, keys: DataFrame, size: int):
        keys = keys.groupBy("id", "spot").agg(F.sum("bytes").alias("bytes"))
        heavy = keys.groupBy("id").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > size).collect()  # fewer than shards
        self.heavy = {str(r["id"]): 4 * -(-r["bytes"] // size) for r in heavy}
        units = keys.groupBy("id", self.part().alias("part")).agg(F.sum("bytes").alias("bytes"))
        placed = ranged_sums(units, [F.col("id").asc_nulls_first(), F.col("part").asc()], {"before": F.col("bytes")})
        shard = F.floor(F.col("before") / size)
        first = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "part")).alias("first"))
        self.firsts = sorted((r["first"]["known"], r["first"]["id"] or 0, r["first"]["part"]) for r in first.collect())  # a row per shard

    def part(self) -> Column:
        """Of a row with id and spot: its part of a heavy id, else 0."""
        if not self.heavy:
            return F.lit(0)
        counts = F.from_json(F.lit(json.dumps(self.heavy)), "map<string, int>")
        n = F.element_at(counts, F.coalesce(F.col("id").cast("string"), F.lit("None")))
        return F.coalesce(F.pmod(F.col("spot"), n.cast("long")).cast("int"), F.lit(0))

    def shard(self) -> Column:
        """Of a row with id and spot: its shard, by binary search in the first rows of shards."""
        n = len(self.firsts)
        if n < 2:
            return F.lit(0)
        listed = lambda k, kind: F.split(F.lit(",".join(str(int(x[k])) for x in self.firsts)), ",").cast(f"array<{kind}>")
        known, ids, parts = listed(0, "int"), listed(1, "bigint"), listed(2, "int")
        key = (F.col("id").isNotNull().cast("int"), F.coalesce("id", F.lit(0)).cast("long"), self.part())

        def passed(at: Column) -> Column:
            a, b, c = F.get(known, at), F.get(ids, at), F.get(parts, at)
            return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c <= key[2]))))

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            up = (acc["lo"] < acc["hi"]) & passed(mid)
            down = (acc["lo"] < acc["hi"]) & ~passed(mid)
            return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(down, mid).otherwise(acc["hi"]).alias("hi"))

        steps = F.sequence(F.lit(1), F.lit(n.bit_length() + 1))
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve, lambda acc: acc["lo"] - 1)


#: Tasks that write shards, at most; beyond, a task writes several, one after the other.
WRITERS = 10_000


def dealt_to_shards(df: DataFrame, n: int) -> DataFrame:
    """Rows with a column shard, those of a shard in one partition, neighbouring shards together beyond WRITERS."""
    tasks = max(1, min(n, WRITERS))
    return df.repartitionById(tasks, F.floor(F.col("shard").cast("long") * tasks / max(1, n)).cast("int"))


def small(df: DataFrame, most: int) -> DataFrame:
    """Marks the frame for broadcast if it is counted to hold no more rows than that; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
