"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Targets come from water-filling over the sources' sizes. Within a source every document has the expected copies
target / size of the source; in a fixed order their prefix sums, moved by one offset drawn from the source's name, cross
an integer once for each copy. The order goes by size classes, then by hash, so that each class is sampled in proportion
and the words taken come near the target. Places in the order are the counts of earlier buckets plus the place in the
own bucket: a source is dealt to many buckets (size class and hash of id and text), so that a hot source is spread over all
tasks.

Sources may be as many as they like: their numbers and the water-filling are prefix sums over ranges (``ranged_sums``), no row
of theirs reaches the driver, and their table is broadcast up to a counted size and joined by shuffle beyond.

Defined cases: a null or blank text has size 0; a null source is a source of its own and last; a source of size 0 has
target 0 and takes no copies; null and repeated ids are told apart by their texts; equal rows are sampled as separate documents;
rows equal in id and text go by a hash of all columns; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import drop, fresh, materialize, ranged_sums, small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Rows of the table of sources up to which it is broadcast.
BROADCAST_ROWS = 200_000
#: A source has a part for so many documents; each part is divided by size classes.
BUCKET = 2_000
#: Parts whose counts are summed in one window.
FAN = 1_000
#: Size classes double every so many steps.
CLASSES = 8


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(number, source, source_size, target, documents) with a row per source.

    Water-filling by sorting: no target is above `most` times its source's size, and the excess is reshared by weight. A source
    is at that limit if filling all of smaller limits for their weight leaves it at least as much.
    """
    per = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(size_of(F.col(text_col))).alias("source_size"), F.count("*").alias("documents"))
    numbered = ranged_sums(materialize(per, "mix-sizes"), [F.col("source").asc_nulls_last()], {"number": F.lit(1).cast("long")})
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights)).cast("int"))
    sized = numbered.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    order = [(F.col("limit").cast("double") / F.col("weight")).asc(), F.col("number").asc()]
    placed = materialize(ranged_sums(sized, order, {"below": F.col("limit"), "passed": F.col("weight")}), "mix-placed")
    whole = placed.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weights")).first()  # one row
    total = share * (whole["all"] or 0)
    capped = (F.lit(total) - F.col("below")) * F.col("weight") / (F.lit(whole["weights"] or 0) - F.col("passed")) > F.col("limit")
    put = placed.withColumn("capped", capped)
    rest = put.agg(F.sum(F.when(F.col("capped"), F.col("limit"))).alias("taken"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("free")).first()  # one row
    left, free = total - (rest["taken"] or 0), rest["free"] or 1
    target = F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(F.lit(left) * F.col("weight") / F.lit(free))
    return put.select("number", "source", "source_size", target.alias("target"), "documents")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def assign(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> tuple[DataFrame, str]:
    """The rows of docs with a struct column of size, source_size, target, copies; and that column's name."""
    sources = materialize(plan(docs, text_col, source_col), "mix-sources")
    # What is joined comes in one column whose name no document column has.
    mix, key, bucket, place, src, base = (fresh(docs, n) for n in ("mix", "mix_key", "mix_bucket", "mix_place", "mix_source", "mix_base"))
    sources = small(sources.select(F.struct(*sources.columns).alias(src)), BROADCAST_ROWS)
    q = lambda name: F.col(f"`{name}`")
    name = F.coalesce(q(id_col).cast("string"), F.lit(""))
    u = _unit(name, F.md5(F.coalesce(q(text_col), F.lit(""))), F.lit("mix"))
    marked = docs.withColumn(key, F.struct(size_of(q(text_col)).alias("size"), u.alias("u"), q(source_col).cast("string").alias("source")))
    joined = marked.join(sources, q(key)["source"].eqNullSafe(q(src)["source"]))
    parts = F.greatest(F.lit(1), F.ceil(q(src)["documents"] / BUCKET))
    cls = F.floor(F.log2(q(key)["size"] + 1.0) * CLASSES)
    rate = F.when(q(src)["source_size"] > 0, q(src)["target"] / q(src)["source_size"]).otherwise(F.lit(0.0))
    dealt = joined.select(
        *[q(c) for c in docs.columns],
        q(key),
        F.struct(q(src)["number"].alias("number"), cls.alias("cls"), F.floor(q(key)["u"] * parts).alias("part")).alias(bucket),
        F.struct(q(src)["source_size"].alias("source_size"), q(src)["target"].alias("target"), rate.alias("rate")).alias(mix),
    )
    group = ["number", "cls", "part"]
    # Only three columns of the documents are read here; the text only for its size.
    counts = dealt.groupBy(*[q(bucket)[g].alias(g) for g in group]).agg(F.count("*").alias("n"))
    counts = materialize(counts, "mix-counts")
    bases = materialize(prefix_sums(counts), "mix-bases")
    bases = bases.select(F.struct(*bases.columns).alias(base))
    drop(counts)
    others = [q(c) for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)]
    inside = Window.partitionBy(*[q(bucket)[g] for g in group]).orderBy(q(key)["size"], q(key)["u"], q(id_col), F.xxhash64(q(text_col)), F.xxhash64(*others))
    placed = dealt.withColumn(place, F.row_number().over(inside))
    # Counts of buckets: far fewer than documents; joined by shuffle unless Spark finds them small.
    same = [q(bucket)[g] == q(base)[g] for g in group]
    offset = _unit(F.coalesce(q(key)["source"], F.lit("")), F.lit("offset"))
    rank = q(base)["base"] + q(place)
    copies = F.floor(rank * q(mix)["rate"] + offset) - F.floor((rank - 1) * q(mix)["rate"] + offset)
    out = placed.join(bases, same).select(
        *[q(c) for c in docs.columns],
        F.struct(q(key)["size"].alias("size"), q(mix)["source_size"].alias("source_size"), q(mix)["target"].alias("target"), copies.cast("long").alias("copies")).alias(mix),
    )
    return out, mix


def prefix_sums(counts: DataFrame) -> DataFrame:
    """(number, cls, part, base): base is the documents of the source in earlier classes, or in earlier parts of the class.

    In three levels, so that no window grows with a source: within FAN parts, over such groups within a class, and over the
    classes of a source. Each level's sums are made with partial aggregation.
    """
    counts = counts.withColumn("hi", F.floor(F.col("part") / FAN))

    def level(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)))

    parts = level(counts, ["number", "cls", "hi"], "part", "base1")
    groups = level(counts.groupBy("number", "cls", "hi").agg(F.sum("n").alias("n")), ["number", "cls"], "hi", "base2").drop("n")
    classes = level(counts.groupBy("number", "cls").agg(F.sum("n").alias("n")), ["number"], "cls", "base3").drop("n")
    both = parts.join(groups, ["number", "cls", "hi"]).join(classes, ["number", "cls"])
    return both.select("number", "cls", "part", (F.col("base1") + F.col("base2") + F.col("base3")).alias("base"))


def emit(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mix: each row as many times as it has copies, with its columns."""
    out, mix = assign(docs, id_col, text_col, source_col)
    n = F.col(f"`{mix}`")["copies"].cast("int")
    once = fresh(docs, "mix_copy")
    return out.where(n > 0).withColumn(once, F.explode(F.sequence(F.lit(1), n))).select(*[F.col(f"`{c}`") for c in docs.columns])
