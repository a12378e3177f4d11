"""Exact and fuzzy joins on tiered keys.

Both sides carry a position (``__pos``), so that "first" means the same in every run. Destination columns are renamed
before the join: what the source has as well gets a suffix that is free (``_dst``, ``_dst2``, …).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.address import Patterns
from ..functions.text import POS, column, tie_key, tier

DST_POS = "__dst_pos"
#: Keys of a side in a block of the fuzzy join.
BLOCK = 1024
#: Destination keys, and their characters in all, up to which they go to every task; beyond, blocks of both sides meet.
BROADCAST_KEYS = 20_000
BROADCAST_CHARS = 4_000_000
#: Pairs of keys that a block scores in the time that the index of tokens takes for one.
PAIRS_A_CANDIDATE = 200


@dataclass(frozen=True)
class Norm:
    name_aliases: Mapping[str, str] = field(default_factory=dict)
    name_stopwords: Sequence[str] = ()
    addr_aliases: Mapping[str, str] = field(default_factory=dict)
    addr_stopwords: Sequence[str] = ()
    addr_patterns: Patterns = Patterns()


@dataclass(frozen=True)
class TieBreaker:
    column: str
    strip_prefix: str = ""
    order: str = "asc"

    @classmethod
    def of(cls, spec: Mapping | None) -> "TieBreaker | None":
        return spec and cls(spec["column"], spec.get("strip_prefix", ""), spec.get("order", "asc"))


def with_position(df: DataFrame) -> DataFrame:
    return df if POS in df.columns else df.withColumn(POS, F.monotonically_increasing_id())


def suffix_for(source: Sequence[str], destination: Sequence[str]) -> str:
    taken, n = set(source), 1
    shared = [c for c in destination if c in taken]
    while any(c + (s := "_dst" if n == 1 else f"_dst{n}") in taken for c in shared):
        n += 1
    return "_dst" if n == 1 else f"_dst{n}"


def renamed(source: Sequence[str], destination: Sequence[str]) -> dict[str, str]:
    """Destination column -> its name in the matched frame."""
    suffix = suffix_for(source, [c for c in destination if not c.startswith("__")])
    return {c: c + suffix if c in source else c for c in destination if not c.startswith("__")}


def _order(tie: TieBreaker | None, name: str | None):
    """Which destination goes first: the tie-breaker's, then the earlier one. Nulls first, whatever the direction."""
    out = []
    if tie and name:
        key = tie_key(column(name), tie.strip_prefix)
        out.append(key.desc_nulls_first() if tie.order == "desc" else key.asc_nulls_first())
    return [*out, F.col(DST_POS).asc()]


def _sides(src: DataFrame, dst: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    src, dst = with_position(src), with_position(dst)
    names = renamed(src.columns, dst.columns)
    right = dst.select(F.col(POS).alias(DST_POS), *[column(c).alias(n) for c, n in names.items()])
    return src, right, names


def _keys(df: DataFrame, field: str, tiers: Sequence[str], norm: Norm) -> DataFrame:
    """A row per tier: its number and the row's key under it."""
    built = [F.struct(F.lit(i).alias("n"), tier(t, column(field), norm.name_aliases, norm.name_stopwords).alias("k")) for i, t in enumerate(tiers)]
    return df.withColumn("__key", F.explode(F.array(*built))).withColumns({"__tier": F.col("__key.n"), "__k": F.col("__key.k")}).drop("__key")


def _of_first_tier(a: DataFrame, met: DataFrame, key: str) -> DataFrame:
    """Of the sources' rows (one a tier) those of each key's first tier that has a match; met are the rows with one. Tiers are aggregated and
    joined back before the join with the destinations, so that matches are neither shuffled nor made for tiers that aren't
    wanted, and no key's rows, nor those without one, gather in a task."""
    best = met.groupBy(column(key).alias("__bk")).agg(F.min("__tier").alias("__best"))
    return a.join(best, column(key).eqNullSafe(F.col("__bk")) & (F.col("__tier") == F.col("__best"))).drop("__best", "__bk")


def _present(b: DataFrame, own: str | None) -> DataFrame:
    """A row for each (tier, key) of the destinations; where a source must not meet itself, with the least and largest of their records."""
    records = [F.min(column(own).cast("string")).alias("__own_lo"), F.max(column(own).cast("string")).alias("__own_hi")] if own else []
    return b.groupBy("__tier_d", "__k_d").agg(F.lit(1).alias("__one"), *records).drop("__one")


def _another(exclude_self: str):
    """Whether a source has a destination of another record: the least or the largest is one."""
    own = column(exclude_self).cast("string")
    return (F.col("__own_lo") != own) | (F.col("__own_hi") != own)


def _firsts(b: DataFrame, order: list, own: str | None) -> DataFrame:
    """Of the destinations of each (tier, key) the first, which is all that a best match can be; where a source must not meet itself
    (own has the destination's record) the first of another record as well. First rows are picked before the shuffle
    and again after it, so a key that a third of all destinations share stays small."""
    first = lambda df: df.withColumn("__first", F.row_number().over(Window.partitionBy("__tier_d", "__k_d").orderBy(*order))).where("__first = 1").drop("__first")
    if own is None:
        return first(b)
    name = column(own).cast("string")
    b = b.where(name.isNotNull())
    one = first(b)
    taken = one.select(F.col("__tier_d").alias("__t1"), F.col("__k_d").alias("__k1"), name.alias("__own1"))
    others = b.join(taken, (F.col("__tier_d") == F.col("__t1")) & (F.col("__k_d") == F.col("__k1")) & (name != F.col("__own1"))).drop("__t1", "__k1", "__own1")
    return one.unionByName(first(others))


def _top(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(column(key)).orderBy(*order))).where("__rank = 1").drop("__rank")


def _named(df: DataFrame, tiers: Sequence[str]) -> DataFrame:
    names = F.create_map(*[x for i, t in enumerate(tiers) for x in (F.lit(i), F.lit(t))])
    return df.withColumn("match_tier", names[F.col("__tier")])


def exact(
    src: DataFrame, dst: DataFrame, src_field: str, dst_field: str, tiers: Sequence[str] = ("raw", "clean"), norm: Norm = Norm(),
    key: str | None = None, exclude_self: str | None = None, mode: str = "best_match", tie: TieBreaker | None = None,
) -> DataFrame:
    """Equal keys under the first tier that matches. All tiers are joined at once, on (tier, key). For a best match the
    destinations are cut down to the first of each (tier, key) before, so that a source row meets one row a tier, however many
    rows on either side share a key.

    best_match keeps the first destination of each source key; all_matches every one of the first successful tier. Null
    keys never match, empty ones do.
    """
    tiers = list(tiers) or ["raw", "clean"]
    left, right, names = _sides(src, dst)
    key = key or src_field
    a = _keys(left, src_field, tiers, norm).where(F.col("__k").isNotNull())
    b = _keys(right, names[dst_field], tiers, norm).where(F.col("__k").isNotNull())
    b = b.withColumnsRenamed({"__tier": "__tier_d", "__k": "__k_d"})
    order = _order(tie, names.get(tie.column) if tie else None)
    own = names.get(exclude_self) if exclude_self else None
    same = (F.col("__tier") == F.col("__tier_d")) & (F.col("__k") == F.col("__k_d"))
    if mode != "all_matches":
        b = _firsts(b, order, own)
    else:
        met = a.join(_present(b, own), same)
        a = _of_first_tier(a, met.where(_another(exclude_self)) if own else met, key)
    out = a.join(b, same).drop("__tier_d", "__k_d", "__k")
    if own:
        out = out.where(column(exclude_self).cast("string") != column(own).cast("string"))
    if mode != "all_matches":
        out = _top(out, key, [F.col("__tier"), *order, F.col(POS)])
    return _named(out, tiers).drop("__tier")


def _blocks(keys: DataFrame, side: str, size: int) -> DataFrame:
    """Keys (x.s, x.k, …) in blocks of neighbouring lengths and about `size` keys: a band of lengths takes the next ones until it
    is full, and a length with more keys than that has several parts, dealt by hash. So no block grows with the data.
    Returns (side_band, side_part, side, side_lo, side_hi), the last two the block's shortest and longest length."""
    sized = keys.withColumn("len", F.length("x.s"))
    lengths = sized.groupBy("len").agg(F.count("*").alias("n"))  # a row for each length: few
    before = F.sum("n").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, -1))
    bands = lengths.select("len", F.floor(F.coalesce(before, F.lit(0)) / size).alias("band"), F.ceil(F.col("n") / size).alias("parts"))
    dealt = sized.join(bands, "len").withColumn("part", F.pmod(F.xxhash64("x.k"), F.col("parts")))
    grouped = dealt.groupBy("band", "part").agg(F.collect_list("x").alias(side), F.min("len").alias("lo"), F.max("len").alias("hi"))
    return grouped.toDF(f"{side}_band", f"{side}_part", side, f"{side}_lo", f"{side}_hi")


def score_keys(left: DataFrame, right: DataFrame, scorer: str, threshold: float, best_only: bool = False) -> DataFrame:
    """(a, b, score) of keys that score at least the threshold.

    left and right have distinct keys (k), right with the position of the first row that has it (pos). Keys are put in blocks
    of like length. For scorers whose score a difference in length bounds, only blocks whose lengths can reach the
    threshold meet, without recall loss; so they do for token_set_ratio, whose other pairs come from an index of tokens; for the others
    all blocks meet. Which meet is decided on the blocks' lengths
    alone, and the blocks then follow by equality joins. Pairs never leave the task that scores them unless they reach the
    threshold; with best_only only the best of each block does.
    """
    scorer = scorer if scorer in similarity.SCORERS else "token_sort_ratio"
    bound, by_set = scorer in similarity.LENGTH_BOUND, scorer == "token_set_ratio"
    if scorer == "token_sort_ratio":
        resort = lambda c: F.array_join(F.array_sort(_tokens(c)), " ")
    elif by_set:
        resort = lambda c: F.array_join(F.array_sort(F.array_distinct(_tokens(c))), " ")
    else:
        resort = lambda c: c
    a = left.select(F.struct(resort(F.col("k")).alias("s"), F.col("k").alias("k")).alias("x"))
    b = right.select(F.struct(resort(F.col("k")).alias("s"), F.col("k").alias("k"), F.col("pos").alias("pos")).alias("x"))
    if (few := _if_few(b)) is not None:
        return _score_few(a, few, scorer, threshold, best_only, bound)
    if by_set and 0 < threshold <= 100:
        if not _few_candidates(left, right, threshold):
            return _score_blocks(a, b, scorer, threshold, best_only, False)
        # Where the tokens that a pair shares don't reach the threshold by themselves, the sets' lengths bound the score.
        near = _score_blocks(a, b, scorer, threshold, best_only, True)
        return near.unionByName(_shared_tokens(left, right, threshold)).groupBy("a", "b").agg(F.max("score").alias("score"))
    return _score_blocks(a, b, scorer, threshold, best_only, bound)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


def _lookups(left: DataFrame, right: DataFrame, threshold: float) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(key, t) of both sides, a and b: all tokens, and those that are looked up in the other side's."""
    t = threshold - 1e-4
    sides = {s: df.select(F.col("k").alias(s), F.explode(F.array_distinct(_tokens(F.col("k")))).alias("t")) for s, df in (("a", left), ("b", right))}
    counts = sides["a"].select("t").unionByName(sides["b"].select("t")).groupBy("t").agg(F.count("*").alias("n"))

    def rarest(s: str) -> DataFrame:
        own = sides[s].join(counts, "t").groupBy(s).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("xs"))  # a key's own tokens
        weight = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + F.length(x["t"]) + 1)
        need = (weight(F.col("xs")) - 1) * t / (200 - t) + 1
        kept = F.filter(F.col("xs"), lambda x, i: weight(F.slice("xs", i + 1, F.size("xs"))) >= need)
        return own.select(s, F.explode(F.transform(kept, lambda x: x["t"])).alias("t"))

    return sides, {s: rarest(s) for s in sides}


def _few_candidates(left: DataFrame, right: DataFrame, threshold: float) -> bool:
    """Whether the index of tokens lets so few pairs meet that it takes less than blocks of all. Tables whose keys are made of a few words
    meet nearly all by it. One job counts the tokens, forms no pair and gives the number of those that would meet."""
    sides, rare = _lookups(left, right, threshold)
    rows = None
    for c, df in (("na", sides["a"]), ("nb", sides["b"]), ("ra", rare["a"]), ("rb", rare["b"])):
        part = df.groupBy("t").agg(F.count("*").cast("double").alias(c))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    sums = rows.groupBy("t").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("na", "nb", "ra", "rb")])
    met = sums.agg(F.sum(F.col("ra") * F.col("nb") + F.col("na") * F.col("rb")).alias("met"))
    keys = [df.agg(F.count("*").cast("double").alias(n)) for n, df in (("a", left), ("b", right))]
    got = met.crossJoin(keys[0]).crossJoin(keys[1]).first()
    return (got["met"] or 0) * PAIRS_A_CANDIDATE <= got["a"] * got["b"]


def _shared_tokens(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of pairs whose shared tokens, of I characters with the blanks between, reach the threshold by themselves against
    one side's set of tokens, of n: 200 I / (I + n).

    That takes shared tokens of at least n t / (200 - t) characters, so that one of them is among the side's rarest tokens, down to
    where the commoner ones together have fewer: only these are looked up in the other side's index, and frequent
    tokens meet nothing unless a key is made of little else.
    """
    sides, rare = _lookups(left, right, threshold)
    met = rare["a"].join(sides["b"], "t").select("a", "b").unionByName(sides["a"].join(rare["b"], "t").select("a", "b")).distinct()
    size = lambda xs: F.length(F.array_join(xs, " "))
    both = F.array_intersect(F.array_distinct(_tokens(F.col("a"))), F.array_distinct(_tokens(F.col("b"))))
    sized = met.select("a", "b", size(both).alias("i"), size(F.array_distinct(_tokens(F.col("a")))).alias("m"), size(F.array_distinct(_tokens(F.col("b")))).alias("n"))
    score = F.when((F.col("i") == F.col("m")) | (F.col("i") == F.col("n")), 100.0).otherwise(200.0 * F.col("i") / (F.col("i") + F.least("m", "n")))
    return sized.withColumn("score", score).where(F.col("score") >= threshold).select("a", "b", F.col("score").cast("float").cast("double").alias("score"))


def _score_blocks(a: DataFrame, b: DataFrame, scorer: str, threshold: float, best_only: bool, bound: bool) -> DataFrame:
    # A block is shuffled once for each that it meets: the larger, the less is moved.
    a, b = _blocks(a, "a", 2 * BLOCK), _blocks(b, "b", 4 * BLOCK)
    meet = a.select("a_band", "a_part", "a_lo", "a_hi").crossJoin(b.select("b_band", "b_part", "b_lo", "b_hi"))  # of blocks' lengths
    if bound and threshold > 0:
        t = threshold - 1e-4  # 200 * min(m, n) / (m + n) >= t, for lengths m and n
        meet = meet.where((F.col("b_hi") * (200 - t) >= F.col("a_lo") * t) & (F.col("a_hi") * (200 - t) >= F.col("b_lo") * t))
    pairs = meet.drop("a_lo", "a_hi", "b_lo", "b_hi").join(a.drop("a_lo", "a_hi"), ["a_band", "a_part"]).join(b.drop("b_lo", "b_hi"), ["b_band", "b_part"])
    # A block pair is much work on few bytes: they are spread one by one, not merged by size.
    pairs = pairs.select("a", "b").repartition(max(64, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a pair of blocks at a time, not a batch of them
                row = batch.slice(i, 1).to_pylist()[0]
                yield from _hits(row["a"], [_Targets(row["b"])], scorer, threshold, best_only, bound)

    return pairs.mapInArrow(run, "a string, b string, score double")


def _if_few(b: DataFrame) -> list[dict] | None:
    """The destination keys, if they are few and short, else None: one job decides. It takes no more keys than the bound and one, and
    hands over a mark in place of keys that have too many characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, chars, held = 0, 0, []
        for batch in batches:
            x = batch.column(0)
            n, chars = n + batch.num_rows, chars + int(pa.compute.sum(pa.compute.utf8_length(x.field("k"))).as_py() or 0)
            if n > BROADCAST_KEYS or chars > BROADCAST_CHARS:
                yield pa.RecordBatch.from_pylist([{"s": None, "k": None, "pos": None}], schema=kinds)
                return
            held.append(pa.RecordBatch.from_arrays([x.field(c) for c in ("s", "k", "pos")], schema=kinds))
        yield from held

    kinds = pa.schema([("s", pa.string()), ("k", pa.string()), ("pos", pa.int64())])
    rows, chars = [], 0
    for r in b.limit(BROADCAST_KEYS + 1).mapInArrow(run, "s string, k string, pos long").collect():
        if r["s"] is None:
            return None
        rows.append(r.asDict())
        chars += len(r["k"])
    return rows if len(rows) <= BROADCAST_KEYS and chars <= BROADCAST_CHARS else None


class _Targets:
    """A block of destination keys as a task scores them."""

    def __init__(self, rows: Sequence[Mapping]):
        self.block = similarity.Forms([r["s"] for r in rows])
        self.keys, self.pos = [r["k"] for r in rows], np.array([r["pos"] for r in rows], np.int64)
        lengths = [len(r["s"]) for r in rows]
        self.lo, self.hi = min(lengths, default=0), max(lengths, default=0)


def _hits(sources: Sequence[Mapping], targets: Sequence[_Targets], scorer: str, threshold: float, best_only: bool, bound: bool) -> Iterator[pa.RecordBatch]:
    out: list[tuple[str, str, float]] = []
    t = threshold - 1e-4
    for x in sources:
        n, best = len(x["s"]), None
        for b in targets:
            if bound and threshold > 0 and (b.hi * (200 - t) < n * t or n * (200 - t) < b.lo * t):
                continue
            s = similarity.block_scores(scorer, b.block, x["s"], threshold)
            if not best_only:
                hit = np.flatnonzero(s >= threshold) if threshold > 0 else np.arange(len(s))
                out += [(x["k"], b.keys[i], float(np.float32(s[i]))) for i in hit]
            elif len(s) and (top := s.max()) >= threshold:
                hit = np.flatnonzero(s == top)
                i = hit[b.pos[hit].argmin()]
                if best is None or (top, -b.pos[i]) > best[:2]:
                    best = (top, -b.pos[i], b.keys[i])
        if best:
            out.append((x["k"], best[2], float(np.float32(best[0]))))
        if len(out) >= 50_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
    a, b, score = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score, pa.float64())], ["a", "b", "score"])


def _score_few(a: DataFrame, few: list[dict], scorer: str, threshold: float, best_only: bool, bound: bool) -> DataFrame:
    """As score_keys, where the destinations are counted to be few: their keys go to every task, and no block is shuffled."""
    spark = a.sparkSession
    rows = sorted(few, key=lambda r: len(r["s"]))
    sent = spark.sparkContext.broadcast([rows[i : i + 2 * BLOCK] for i in range(0, len(rows), 2 * BLOCK)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets = None
        for batch in batches:
            targets = targets or [_Targets(part) for part in sent.value]
            yield from _hits([x["x"] for x in batch.to_pylist()], targets, scorer, threshold, best_only, bound)

    # Much work on few bytes: keys are spread evenly, not merged by size.
    spread = a.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(run, "a string, b string, score double")


def fuzzy(
    src: DataFrame, dst: DataFrame, src_field: str, dst_field: str, tiers: Sequence[str] = ("raw", "clean"), threshold: float = 80,
    scorer: str = "token_sort_ratio", norm: Norm = Norm(), key: str | None = None, exclude_self: str | None = None,
    mode: str = "best_match", tie: TieBreaker | None = None,
) -> DataFrame:
    """Similar keys under the first tier that matches. Scores depend on keys alone, so distinct keys are scored, and rows
    join their results. Null keys count as empty."""
    tiers = list(tiers) or ["raw", "clean"]
    left, right, names = _sides(src, dst)
    key = key or src_field
    tied = names.get(tie.column) if tie else None
    a = _keys(left, src_field, tiers, norm).withColumn("__k", F.coalesce("__k", F.lit("")))
    b = _keys(right, names[dst_field], tiers, norm).withColumn("__k", F.coalesce("__k", F.lit("")))
    best_only = mode != "all_matches" and not exclude_self and not tied
    found = None
    for i in range(len(tiers)):
        ka = a.where(F.col("__tier") == i).select(F.col("__k").alias("k")).distinct()
        kb = b.where(F.col("__tier") == i).groupBy(F.col("__k").alias("k")).agg(F.min(DST_POS).alias("pos"))
        part = score_keys(ka, kb, scorer, threshold, best_only).withColumn("__t", F.lit(i))
        found = part if found is None else found.unionByName(part)
    b = b.withColumnsRenamed({"__tier": "__tier_d", "__k": "__k_d"})
    scored = (F.col("__tier") == F.col("__t")) & (F.col("__k") == F.col("a"))
    same = (F.col("__tier") == F.col("__tier_d")) & (F.col("b") == F.col("__k_d"))
    order, own = _order(tie, tied), names.get(exclude_self) if exclude_self else None
    if mode != "all_matches":
        b = _firsts(b, order, own)  # equal keys have equal scores
    elif own:
        a = _of_first_tier(a, a.join(found, scored).join(_present(b, own), same).where(_another(exclude_self)), key)
    else:
        a = _of_first_tier(a, a.join(found.select("__t", "a").distinct(), scored), key)
    out = a.join(found, scored).drop("__t", "a", "__k").join(b, same).drop("__tier_d", "__k_d", "b")
    out = out.withColumnRenamed("score", "name_score")
    if own:
        out = out.where(column(exclude_self).cast("string") != column(own).cast("string"))
    if mode != "all_matches":
        out = _top(out, key, [F.col("__tier"), F.col("name_score").desc(), *order, F.col(POS)])
    return _named(out, tiers).drop("__tier")
