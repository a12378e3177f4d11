"""Quality rules with cross-document line frequency. DataFrame functions only.

Texts are read once: the base figures and, for each line, a hash of its normalised form (case, digits, inner white space) and its
words go to a table that holds no text. From that table the distinct documents of each host that hold a line are counted.
Lines of any length held by more documents than the limit are boilerplate and are removed; a document that keeps too little
without them is rejected. ``keep`` returns the texts of all others without those lines; ``judge`` returns figures and
the digest and length of what is left.

Documents are distinct by their text, so that mass copies of one text don't make its own lines boilerplate (they are the
near-duplicate stage's to thin out); with ``distinct="id"`` each document counts for itself.

Defined cases: a null or blank text has no words and fails the base rule; a null host is a host of its own; repeated
rows each get the same verdict; rows equal in id but not in text are told apart; an empty table gives an empty result; other
columns are ignored by ``judge`` and carried along by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, words


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: A line is boilerplate in a host if more distinct documents than this hold it.
    max_line_documents: int = 20
    #: What tells documents apart there: "text", or "id" (and text).
    distinct: str = "text"
    #: A document is depleted if fewer words than min_words, or a smaller share than this, are left.
    min_left_percent: int = 30


def _let(value: Column, body) -> Column:
    """Evaluates value once per row and hands it to body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(tokens: Column, window: int) -> Column:
    """Words in windows found twice or more, the first place included.

    Windows are hashed to 64 bits. Only a text with a repeated hash sorts its (hash, place) pairs; equal neighbours give
    the places of repeats, and the union of [place, place + window) is counted in one pass over the sorted places.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            hit = F.filter(
                s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            )
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(
            _let(pairs, places),
            start,
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    def of(ids: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(ids) - window), lambda i: F.xxhash64(*[F.get(ids, i + k) for k in range(window)])
        )
        return _let(
            grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))
        )

    return F.when(F.size(tokens) <= window, F.lit(0).cast("long")).otherwise(
        _let(F.transform(tokens, lambda w: F.xxhash64(w)), of)
    )


def measures(text: Column, rules: Rules = Rules()) -> Column:
    """The base figures of a text, as a struct."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(
        words(full),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w, rules.window).alias("repeats")
        ),
    )
    return F.struct(
        of_words.alias("words"),
        F.regexp_count(full, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def marks(text: Column, digests: bool = True) -> Column:
    """For each line of a text: the hash of its normalised form, its words, and (with digests) the digest and length of the line
    itself."""
    full = F.coalesce(text, F.lit(""))
    plain = F.regexp_replace(F.lower(F.regexp_replace(full, "[0-9]+", "0")), r"[\x20\x09\x0B-\x0D]+", " ")
    n = lambda x: F.when(x == "", F.lit(0)).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    normal = F.transform(F.split(plain, "\n"), lambda x: _let(F.trim(x), lambda t: F.struct(F.xxhash64(t).alias("line"), n(t).alias("n"))))
    if not digests:
        return normal
    return _let(
        normal,
        lambda p: F.transform(
            F.split(full, "\n"),
            lambda x, i: F.struct(F.get(p, i)["line"].alias("line"), F.get(p, i)["n"].alias("n"), F.md5(x).alias("digest"), F.length(x).alias("chars")),
        ),
    )


def figures(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", rules: Rules = Rules(), digests: bool = True) -> DataFrame:
    """The one pass over texts: id, body (hash of the text), host, the base figures, and marks of the lines."""
    m = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"), F.col(host_col).alias("host"),
        measures(F.col(text_col), rules).alias("m"), marks(F.col(text_col), digests).alias("lines"),
    )
    return m.select(
        "id", "body", "host", F.col("m.words.n").alias("n_words"), F.col("m.words.chars").alias("word_chars"), "m.n_symbols", "m.n_dup_lines",
        F.col("m.words.repeats").alias("n_repeat_words"), "lines",
    )


def frequent_lines(table: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(host, line) of the boilerplate: a line's distinct documents are first made distinct by (host, line, document), which
    spreads even a line that a third of all documents hold, and only then counted by (host, line) with partial sums."""
    if rules.distinct not in ("text", "id"):
        raise ValueError(f"documents are told apart by text or id, not by {rules.distinct!r}")
    unit = F.col("body") if rules.distinct == "text" else F.xxhash64("id", "body")
    seen = table.select("host", unit.alias("unit"), F.explode("lines").alias("x")).where("x.n > 0").select("host", F.col("x.line").alias("line"), "unit").distinct()
    return seen.groupBy("host", "line").count().where(F.col("count") > rules.max_line_documents).select("host", "line")


def decided(table: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The table of figures with n_boilerplate, places (those of the boilerplate lines, null if there are none), base_failed, kept."""
    rows = table.select("id", "body", "host", F.posexplode("lines").alias("place", "x")).where("x.n > 0")
    lines = rows.select("id", "body", "host", "place", F.col("x.line").alias("line"), F.col("x.n").alias("n")).alias("l")
    often = frequent_lines(table, rules).alias("o")
    found = lines.join(often, F.col("l.host").eqNullSafe(F.col("o.host")) & (F.col("l.line") == F.col("o.line"))).select("l.id", "l.body", "l.host", "l.place", "l.n")
    cut = (
        found.distinct()  # repeated rows name the same lines
        .groupBy("id", "body", "host")
        .agg(F.sum("n").alias("n_boilerplate"), F.sort_array(F.collect_set("place")).alias("places"))
        .alias("c")
    )
    b = table.alias("b")
    same = F.col("b.id").eqNullSafe(F.col("c.id")) & (F.col("b.body") == F.col("c.body")) & F.col("b.host").eqNullSafe(F.col("c.host"))
    out = b.join(cut, same, "left").select("b.*", F.coalesce("c.n_boilerplate", F.lit(0)).cast("long").alias("n_boilerplate"), "c.places")
    left = F.col("n_words") - F.col("n_boilerplate")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    depleted = (F.col("n_boilerplate") > 0) & ((left < rules.min_words) | (100 * left < rules.min_left_percent * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def judge(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", rules: Rules = Rules()) -> DataFrame:
    """A row per input row: id, body (hash of the text), host, the base figures, n_boilerplate, base_failed, kept, and of the
    text without its boilerplate lines clean_chars (code points) and clean_md5 (of the digests of its lines, comma-joined)."""
    table = materialize(figures(docs, id_col, text_col, host_col, rules), "quality-figures")
    out = decided(table, rules)
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))  # in time that grows with the lines
    left = F.when(F.col("places").isNull(), F.col("lines")).otherwise(F.transform(rest, lambda i: F.get("lines", i)))
    chars = F.aggregate("left", F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    return (
        out.withColumn("left", left)
        .withColumns({"clean_chars": chars + F.greatest(F.size("left") - 1, F.lit(0)), "clean_md5": F.md5(F.array_join(F.transform("left", lambda x: x["digest"]), ","))})
        .drop("lines", "places", "left")
    )


def without_lines(text: Column, places: Column) -> Column:
    """The text without its lines at those places; in time that grows with the lines."""
    return _let(
        F.split(text, "\n"),
        lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i)), "\n"),
    )


def keep(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", rules: Rules = Rules()) -> DataFrame:
    """The rows of documents that pass, with all their columns, their texts without the boilerplate lines."""
    body = fresh(docs, "body_hash")
    marked = docs.withColumn(body, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("d")
    table = materialize(figures(docs, id_col, text_col, host_col, rules, digests=False), "quality-figures")
    judged = decided(table, rules).where(~F.col("kept") | F.col("places").isNotNull())
    r = judged.select("id", "body", "host", "kept", "places").distinct().alias("r")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("r.id")) & (F.col(f"d.`{body}`") == F.col("r.body")) & F.col(f"d.`{host_col}`").eqNullSafe(F.col("r.host"))
    text = F.col(f"d.`{text_col}`")
    cut = F.when(F.col("r.places").isNull(), text).otherwise(without_lines(text, F.col("r.places"))).alias(text_col)
    joined = marked.join(r, same, "left").where(F.coalesce(F.col("r.kept"), F.lit(True)))
    return joined.select(*[cut if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
