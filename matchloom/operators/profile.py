"""Column profiler over one token table.

``token_table`` has a row per token of every profiled column and tier; each analysis is an aggregate over it. Limits (top n) are
part of what is reported, and ties are broken by the token itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scripts, similarity
from ..functions.text import column, strip, tier_value, tokens
from ..sources.files import spread
from .joins import POS, with_position

# What the kinds of columns are told by.
DATES = "|".join((r"^\d{4}-\d{2}-\d{2}", r"^\d{1,2}/\d{1,2}/\d{2,4}", r"^\d{1,2}-\d{1,2}-\d{2,4}"))
IDS = r"^[A-Za-z]?\d{3,}$"
NAME_WORDS = "inc llc ltd corp co group pty gmbh sa ag".split()
ADDRESS_WORDS = "street st avenue ave blvd boulevard drive dr road rd lane ln suite ste floor fl pkwy".split()
# Stop words that are suggested wherever they are frequent at all.
KNOWN_STOPWORDS = {
    "name": "inc llc ltd corp co the of and group pty gmbh sa ag limited incorporated corporation".split(),
    "address": "suite ste floor fl unit apt building bldg room rm dept level".split(),
}
SAMPLE = 100
SHARE = 0.3
FLAGGED = 100


def token_table(df: DataFrame, columns: Sequence[str], tiers: Sequence[str] = ("raw", "clean")) -> DataFrame:
    """(column, tier, row, pos, tok, total): pos counts kept tokens from 1, total counts empty ones as well."""
    df = with_position(df)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("tier"), tokens(column(c), t).alias("toks"), F.size(F.split(column(c).cast("string"), " ")).alias("total"))
        for c in columns for t in tiers
    ])
    each = df.select(F.col(POS).alias("row"), F.explode(cells).alias("x")).where(F.col("x.toks").isNotNull())
    out = each.select("x.column", "x.tier", "row", "x.total", F.posexplode("x.toks").alias("pos", "tok"))
    return out.select("column", "tier", "row", (F.col("pos") + 1).alias("pos"), "tok", "total")


def _top(df: DataFrame, n: int | None, key: str = "tok") -> DataFrame:
    out = df.orderBy(F.col("count").desc(), key)
    return out if n is None else out.limit(n)


def top_tokens(toks: DataFrame, n: int | None = 50) -> DataFrame:
    return _top(toks.groupBy("tok").count(), n)


def ngrams(df: DataFrame, name: str, size: int, tier: str = "raw", n: int | None = 50) -> DataFrame:
    """(ngram, count): rows are their places, and a place's words are joined in generated code, which functions of arrays are not; nothing is
    shuffled but the counts."""
    rows = df.select(tokens(column(name), tier).alias("t")).where(F.size("t") >= size)
    places = rows.select("t", F.explode(F.sequence(F.lit(0), F.size("t") - size)).alias("i"))
    gram = F.concat_ws(" ", *[F.get("t", F.col("i") + k) for k in range(size)])
    return _top(places.select(gram.alias("ngram")).groupBy("ngram").count(), n, "ngram")


def singletons(toks: DataFrame, n: int | None = 50) -> DataFrame:
    out = toks.groupBy("tok").count().where("count = 1").select("tok").orderBy("tok")
    return out if n is None else out.limit(n)


def positions(toks: DataFrame, n: int | None = 30) -> DataFrame:
    """(place, tok, count) for first, last and middle tokens, from one aggregate."""
    p, t = F.col("pos"), F.col("total")
    places = F.array(
        F.when(p == 1, "first"), F.when(p == t, "last"), F.when((p > 1) & (p < t) & (t > 2), "middle")
    )
    counted = toks.select("tok", F.explode(places).alias("place")).where(F.col("place").isNotNull()).groupBy("place", "tok").count()
    if n is None:
        return counted
    w = Window.partitionBy("place").orderBy(F.col("count").desc(), "tok")
    return counted.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def lengths(toks: DataFrame) -> DataFrame:
    n = F.length("tok")
    return toks.agg(F.min(n).alias("min"), F.max(n).alias("max"), F.round(F.avg(n), 2).alias("mean"), F.median(n).alias("median"))


def length_histogram(toks: DataFrame) -> DataFrame:
    return toks.groupBy(F.length("tok").alias("length")).count().orderBy("length")


def numeric_ratio(toks: DataFrame) -> DataFrame:
    number, word = F.col("tok").rlike(r"^\d+\.?\d*$"), F.col("tok").rlike("^[A-Za-z]+$")
    out = toks.agg(F.count("*").alias("total_tokens"), F.count_if(number).alias("numeric"), F.count_if(word).alias("alpha"))
    pct = F.when(F.col("total_tokens") > 0, F.round(F.col("numeric") / F.col("total_tokens") * 100, 1)).otherwise(0.0)
    return out.withColumns({"mixed": F.col("total_tokens") - F.col("numeric") - F.col("alpha"), "numeric_pct": pct})


def document_frequency(df: DataFrame, name: str) -> DataFrame:
    """(tok, count): rows that hold the token."""
    return df.select(F.explode(F.array_distinct(tokens(column(name), "clean"))).alias("tok")).groupBy("tok").count()


def suggest_stopwords(df: DataFrame, name: str, kind: str = "name", threshold: float = 0.15, n: int = 20) -> DataFrame:
    """Of the 3n most frequent tokens, those in a large enough share of the rows or known as stop words; n at most."""
    rows = df.agg(F.count(column(name)).alias("rows"))
    known = F.col("tok").isin(KNOWN_STOPWORDS.get(kind, []))
    top = _top(document_frequency(df, name), 3 * n).crossJoin(rows)  # one row
    freq = F.col("count") / F.col("rows")
    return top.where((freq >= threshold) | known).select("tok", F.round(freq, 3).alias("frequency"), "count", known.alias("known")).orderBy(F.col("count").desc(), "tok").limit(n)


def suggest_aliases(toks: DataFrame, n: int | None = 30) -> DataFrame:
    """(canonical, variants, total): tokens that differ in punctuation or case alone, by their counts. Tokens are counted
    before they are grouped, so a group holds distinct spellings."""
    counted = toks.groupBy("tok").count().withColumn("canonical", F.regexp_replace(F.lower("tok"), "[^a-z0-9]", "")).where("canonical <> ''")
    grouped = counted.groupBy("canonical").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "tok"))), lambda x: F.struct(x["tok"].alias("raw"), (-x["c"]).alias("count"))).alias("variants"),
        F.sum("count").alias("total"),
    )
    out = grouped.where(F.size("variants") > 1).orderBy(F.col("total").desc(), "canonical")
    return out if n is None else out.limit(n)


def near_duplicates(toks: DataFrame, most: int = 200, threshold: float = 85, n: int | None = 30) -> DataFrame:
    """(token1, token2, similarity, count1, count2) among the most frequent tokens, of lengths that differ by 2 at most."""
    top = top_tokens(toks, most)
    sized = top.select(F.col("tok").alias("token1"), F.col("count").alias("count1"), F.length("tok").alias("len1"))
    other = sized.toDF("token2", "count2", "len2")
    near = sized.withColumn("len2", F.explode(F.sequence(F.col("len1"), F.col("len1") + 2)))
    pairs = near.join(other, "len2").where((F.col("len1") < F.col("len2")) | (F.col("token1") < F.col("token2")))
    score = similarity.udf("ratio")(F.col("token1"), F.col("token2"))
    out = pairs.withColumn("similarity", score).where(F.col("similarity") >= threshold).select("token1", "token2", "similarity", "count1", "count2")
    out = out.orderBy(F.col("similarity").desc(), "token1", "token2")
    return out if n is None else out.limit(n)


def quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: rows, nulls, distinct values (null is one), duplicates, lengths. Distinct values are counted in long form, as
    (column, 128 bits of the value's hash), which are made distinct with partial sums: columns multiply short rows, never whole ones,
    and no column's values gather."""
    aggs: list[Column] = [F.count("*").alias("rows")]
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    for i, c in enumerate(columns):
        v = column(c)
        size = F.length(v) if c in text else F.lit(None).cast("int")
        aggs += [
            F.count_if(v.isNull()).alias(f"n{i}"), F.max(v.isNull().cast("int")).alias(f"z{i}"),
            F.min(size).alias(f"lo{i}"), F.max(size).alias(f"hi{i}"), F.round(F.avg(size), 1).alias(f"av{i}"),
        ]
    one = df.agg(*aggs)
    pct = lambda c: F.when(F.col("rows") > 0, F.round(c / F.col("rows") * 100, 1)).otherwise(0.0)
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col("rows").alias("total_rows"), F.col(f"n{i}").alias("null_count"), pct(F.col(f"n{i}")).alias("null_pct"),
            (F.col("rows") - F.col(f"n{i}")).alias("non_null"), F.lit(i).alias("i"), F.coalesce(f"z{i}", F.lit(0)).alias("null"), F.col(f"lo{i}").alias("min_length"), F.col(f"hi{i}").alias("max_length"), F.col(f"av{i}").alias("mean_length"),
        )
        for i, c in enumerate(columns)
    ]
    per = one.select(F.col("rows"), F.explode(F.array(*rows)).alias("x")).select("rows", "x.*")
    kinds = dict(df.dtypes)
    plain = lambda c: column(c) + 0.0 if kinds[c] in ("float", "double") else column(c)  # noqa: E731  0.0 and -0.0 are one value
    cells = [F.struct(F.lit(i).alias("i"), column(c).isNotNull().alias("full"), F.xxhash64(plain(c)).alias("h"), F.xxhash64(F.lit(1), plain(c)).alias("k")) for i, c in enumerate(columns)]
    values = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("full").groupBy("i", "h", "k").agg(F.lit(1).alias("one"))
    distinct = values.groupBy("i").agg(F.count("*").alias("values"))  # a row for each column
    unique = F.coalesce("values", F.lit(0)) + F.col("null")
    return per.join(F.broadcast(distinct), "i", "left").select(
        "column", "total_rows", "null_count", "null_pct", "non_null", unique.alias("unique_count"), pct(unique).alias("unique_pct"), (F.col("rows") - unique).alias("duplicate_count"),
        "min_length", "max_length", "mean_length",
    )


def unicode_profile(df: DataFrame, name: str, ranges=None) -> DataFrame:
    """One row: cells, characters by class, cells with unknown characters and of mixed scripts. Counts are native; nothing
    is exploded by character."""
    ranges = ranges or scripts.RANGES
    cells = df.select(strip(F.coalesce(column(name).cast("string"), F.lit(""))).alias("v")).where("v <> ''")
    kinds = [*ranges, "unknown"]
    cells = cells.select("v", scripts.bare(F.col("v")).alias("other"))
    found = scripts.counts(F.col("v"), F.col("other"), ranges)
    counted = cells.select(*[found[k].alias(k) for k in kinds])
    used = sum((F.when(F.col(k) > 0, 1).otherwise(0) for k in ranges if k not in scripts.COMMON), F.lit(0))
    return counted.agg(
        F.count("*").alias("total_cells"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds],
        F.count_if(F.col("unknown") > 0).alias("cells_with_unknown"), F.count_if(used > 1).alias("mixed_script_cells"),
    )


def unicode_flagged(df: DataFrame, name: str, ranges=None, n: int = FLAGGED) -> DataFrame:
    """The first rows with too many unknown characters or mixed scripts."""
    ranges = ranges or scripts.RANGES
    cells = with_position(df).select(F.col(POS).alias("row"), strip(F.coalesce(column(name).cast("string"), F.lit(""))).alias("v")).where("v <> ''")
    cells = cells.select("row", "v", scripts.bare(F.col("v")).alias("other"))
    found = scripts.counts(F.col("v"), F.col("other"), ranges)
    used = sum((F.when(found[k] > 0, 1).otherwise(0) for k in ranges if k not in scripts.COMMON), F.lit(0))
    return cells.where((used > 1) | (found["unknown"] / F.length("v") * 100 > scripts.UNKNOWN_PERCENT)).select("row").orderBy("row").limit(n)


def column_type(df: DataFrame, name: str) -> str:
    """date, id, address, name or freetext: by the first values that aren't null, else by how many differ."""
    v = strip(column(name).cast("string"))
    words = F.transform(F.split(F.lower(v), r"(?U)\s+"), lambda t: F.regexp_replace(t, "[.,]+$", ""))
    holds = lambda known: F.arrays_overlap(words, F.array(*[F.lit(k) for k in known]))
    head = df.where(column(name).isNotNull()).limit(SAMPLE)
    hit = lambda c: F.count_if((v != "") & c)
    got = head.agg(F.count("*").alias("n"), hit(v.rlike(DATES)).alias("date"), hit(v.rlike(IDS)).alias("id"), hit(holds(ADDRESS_WORDS)).alias("address"), hit(holds(NAME_WORDS)).alias("name")).first()
    if not got["n"]:
        return "freetext"
    for kind in ("date", "id", "address", "name"):
        if got[kind] / got["n"] > SHARE:
            return kind
    c = column(name)
    all_ = df.agg(F.count("*").alias("n"), (F.countDistinct(c) + F.max(c.isNull().cast("int"))).alias("d")).first()
    return "id" if all_["n"] and all_["d"] / all_["n"] > 0.9 else "freetext"


def pick_columns(df: DataFrame, wanted: str | None) -> list[str]:
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and not f.name.startswith("__")]
    if wanted and wanted.lower() == "auto":
        return [c for c in text if column_type(df, c) in ("name", "address")] or text
    if not wanted:
        return text
    names = [c.strip() for c in wanted.split(",")]
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return names


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """A report's rows: of bounded number."""
    return [r.asDict(recursive=True) for r in df.collect()]


def analyze_column(df: DataFrame, toks: DataFrame, name: str, kind: str | None = None, n: int = 30) -> dict[str, Any]:
    kind = kind or column_type(df, name)
    of = {t: toks.where((F.col("column") == name) & (F.col("tier") == t)) for t in ("raw", "clean")}
    out: dict[str, Any] = {"column": name, "detected_type": kind}
    for t in ("raw", "clean"):
        out[f"top_tokens_{t}"] = _rows(top_tokens(of[t], n))
        out[f"bigrams_{t}"] = _rows(ngrams(df, name, 2, t, n))
        out[f"trigrams_{t}"] = _rows(ngrams(df, name, 3, t, n))
    return out | {
        "singletons": [r["tok"] for r in _rows(singletons(of["clean"], n))],
        "near_duplicates": _rows(near_duplicates(of["clean"], n=n)),
        "token_positions": _rows(positions(of["clean"], n)),
        "token_lengths": _rows(lengths(of["clean"]))[0] | {"histogram": _rows(length_histogram(of["clean"]))},
        "numeric_ratio": _rows(numeric_ratio(of["raw"]))[0],
        "suggested_stopwords": _rows(suggest_stopwords(df, name, kind)),
        "suggested_aliases": _rows(suggest_aliases(of["raw"])),
        "unicode_profile": _rows(unicode_profile(df, name))[0] | {"flagged_rows": [r["row"] for r in _rows(unicode_flagged(df, name))]},
    }


def analyze(df: DataFrame, columns: Sequence[str], kinds: dict[str, str] | None = None) -> dict[str, Any]:
    """The whole report; the token table is kept for its many readers."""
    # Rows keep their positions when a small file in one split is dealt out to all tasks.
    df = spread(with_position(df)).persist()
    toks = token_table(df, columns).persist()
    try:
        found = {c: analyze_column(df, toks, c, (kinds or {}).get(c)) for c in columns}
        quality_rows = _rows(quality(df, columns))
    finally:
        toks.unpersist()
        df.unpersist()
    stop: dict[str, set[str]] = {}
    aliases: dict[str, str] = {}
    for a in found.values():
        stop.setdefault(a["detected_type"], set()).update(s["tok"] for s in a["suggested_stopwords"] if s["known"] or s["frequency"] >= 0.2)
        for x in a["suggested_aliases"]:
            for v in x["variants"]:
                if (short := tier_value("clean", v["raw"])) != x["canonical"]:
                    aliases[short] = x["canonical"]
    return {"data_quality": quality_rows, "columns": found, "aggregated_stopwords": {k: sorted(v) for k, v in stop.items()}, "aggregated_aliases": aliases}
