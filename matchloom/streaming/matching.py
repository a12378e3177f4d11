"""Recipe steps over a stream: new source rows against standing destinations."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import column, tier
from ..operators.joins import Norm, renamed
from ..plans import pipeline


def exact_stream(source: DataFrame, dst: DataFrame, src_field: str, dst_field: str, name: str = "clean", norm: Norm = Norm()) -> DataFrame:
    """A stream-static join on one tier's key, stateless: every destination of an equal key."""
    names = renamed(source.columns, dst.columns)
    right = dst.select(*[column(c).alias(n) for c, n in names.items()])
    key = lambda f: tier(name, column(f), norm.name_aliases, norm.name_stopwords)
    return source.join(right, key(src_field) == key(names[dst_field])).withColumn("match_tier", F.lit(name))


def keep_first(source: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key within the time that rows may be late; its state is bounded by that."""
    return source.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_recipe(source: DataFrame, recipe: Mapping[str, Any], source_name: str, others: Mapping[str, DataFrame], sink: Callable[[DataFrame, DataFrame, int], None], base_dir: str = ".") -> DataStreamWriter:
    """Each micro-batch of the source goes through the whole recipe, fuzzy steps included; sink gets matched and unmatched
    rows and the batch's number, by which it can write a batch once."""

    def batch(df: DataFrame, number: int) -> None:
        r = pipeline.run(df.sparkSession, recipe, base_dir, sources={**others, source_name: df})
        sink(*pipeline.presented(r), number)

    return source.writeStream.foreachBatch(batch)
