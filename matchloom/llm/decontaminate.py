"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

A probe is a window of consecutive words of a benchmark item. Texts are split into words once; the words are written out, and
the corpus is indexed by position, (term, document, place), for the terms that probes look up: of each window the few that are
rarest in the corpus, by counts over all documents (``full=True`` stores the postings of every term instead; the lookups are the
same). Two questions are put to the index:

* exact phrases: the lists of a window's terms are intersected, each shifted by the term's place in the item, so all that
  is left is starts at which every looked-up term stands right; those are then held against the whole window;
* proximity: places of a window's looked-up terms are dealt to cells as long as the window and the slack; a cell that has them all
  is then held against all words of the window, which must stand, in any order, within that many consecutive words.

The lookups go by the distinct word sequences of items; which items these belong to is only joined to what was found.
What is made from the benchmark alone is broadcast when it is counted to be small and joined by shuffle beyond that.

Defined cases: a null or wordless text has no words and no hits; an item without words has no window; one of fewer words
than the window is one window; items of equal id count once; a null item id is written as an empty string; a window with
a word that the corpus lacks can't occur; repeated document rows each get their row, and rows equal in id are told apart by their
texts; empty tables give empty hits; other columns are ignored, and carried along by ``clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, materialize, small, terms

WINDOW = 10
#: Lists intersected for each window before the whole window is compared.
LISTS = 3
#: Words that may stand between those of a proximity match.
SLACK = 5
#: Words of a text that candidates are held against together.
CELL = 256
#: Rows of a table made from the benchmark alone up to which it is broadcast.
BROADCAST_ROWS = 200_000


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, w): distinct items that have words."""
    return items.select(F.col(id_col).cast("string").alias("item"), terms(F.col(text_col)).alias("w")).where(F.size("w") > 0).distinct()


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body, n_words, line): a document's id, a hash of its text, its words and their number; the words in one string, which
    takes a quarter of an array's room on the way."""
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"), terms(F.col(text_col)).alias("w"))
    return split.select("id", "body", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("line"))


def _words() -> Column:
    return F.when(F.col("n_words") > 0, F.split("line", " ")).otherwise(F.array().cast("array<string>"))


@dataclass
class Index:
    """Tables in the shared folder: the words of documents, the postings, and what these are looked up by."""

    words: DataFrame  # id, body, n_words, line
    postings: DataFrame  # term, id, body, place
    items: DataFrame  # item, key (the number of its word sequence)
    probes: DataFrame  # key, q (the term's place in the item), term
    windows: DataFrame  # key, first (place in the item), words, lists (the places in the item that are looked up)
    size: int  # words of a window, at most

    def drop(self) -> None:
        for t in (self.words, self.postings, self.items, self.probes, self.windows):
            drop(t)


def build_index(
    docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", size: int = WINDOW, lists: int = LISTS, full: bool = False
) -> Index:
    words = materialize(tokens(docs, id_col, text_col), "words")
    listed = materialize(item_words(items, item_id, item_text), "item-names")
    # Word sequences are numbered once and for all when they are written out; postings carry the numbers.
    known = materialize(listed.select("w").distinct().withColumn("key", F.monotonically_increasing_id()), "item-words")
    named = materialize(listed.join(known, "w").select("item", "key"), "items")
    places = known.select("key", F.posexplode("w").alias("q", "term"))
    vocabulary = places.select("term").distinct()
    counts = words.select(F.explode(_words()).alias("term")).join(small(vocabulary, BROADCAST_ROWS), "term").groupBy("term").count()
    counts = materialize(counts, "term-counts")
    counted = places.join(small(counts, BROADCAST_ROWS), "term", "left").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("q", "count"))).alias("at")  # an item's own words
    )
    cut = known.join(counted, "key").withColumn("first", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size))))
    own = F.slice("at", F.col("first") + 1, F.lit(size))
    ranked = F.array_sort(F.transform(own, lambda x: F.struct(x["count"].alias("n"), x["q"].alias("q"))))
    windows = cut.select(
        "key", "first", F.slice("w", F.col("first") + 1, F.lit(size)).alias("words"),
        F.exists(own, lambda x: x["count"].isNull()).alias("missing"), F.transform(F.slice(ranked, 1, lists), lambda x: x["q"]).alias("lists"),
    )
    windows = materialize(windows.where(~F.col("missing")).drop("missing"), "probe-windows")
    wanted = windows.select("key", F.explode("lists").alias("q")).distinct()
    probes = materialize(wanted.join(places, ["key", "q"]), "probes")
    postings = words.select("id", "body", F.posexplode(_words()).alias("place", "term"))
    if not full:
        postings = postings.join(small(probes.select("term").distinct(), BROADCAST_ROWS), "term")
    postings = materialize(postings.select("term", "id", "body", "place"), "postings")
    for t in (counts, listed, known):
        drop(t)
    return Index(words, postings, named, probes, windows, size)


def _bit(q):
    return F.call_function("shiftleft", F.lit(1).cast("long"), (q % 64).cast("int"))


def _masked(index: Index) -> tuple[DataFrame, DataFrame]:
    """Windows with the bits of the places that they look up, and the least number of lookups of any window of an item. Bits are
    places modulo 64: beyond 64 words bits may coincide and let more through to the comparison of whole windows, never less."""
    mask = F.aggregate("lists", F.lit(0).cast("long"), lambda acc, q: acc.bitwiseOR(_bit(q)))
    w = index.windows.withColumns({"mask": mask, "n": F.size("lists")})
    return w, w.groupBy("key").agg(F.min("n").alias("least"), F.max(F.size("words")).alias("size"))


def candidates(index: Index) -> DataFrame:
    """(id, body, start, words): starts at which all looked-up terms of a window stand at their places.

    A posting less the term's place in the item is where the item would begin; postings that agree on that meet in one
    group, with the places they came from as bits. A group with fewer places than any window of the item looks
    up ends there; else the windows whose bits are all set are candidates.
    """
    w, least = _masked(index)
    met = (
        index.postings.join(small(index.probes, BROADCAST_ROWS), "term")
        .select("key", "id", "body", (F.col("place") - F.col("q")).alias("begin"), _bit(F.col("q")).alias("bit"))
        .groupBy("key", "id", "body", "begin").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("met"))
    )
    met = met.join(small(least, BROADCAST_ROWS), "key").where(F.col("met") >= F.col("least"))
    found = met.join(small(w.select("key", "first", "words", "mask"), BROADCAST_ROWS), "key")
    hit = found.where((F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")) & (F.col("begin") + F.col("first") >= 0))
    return hit.select("id", "body", (F.col("begin") + F.col("first")).alias("start"), "words")


def near_candidates(index: Index, slack: int = SLACK) -> DataFrame:
    """(id, body, start, words): stretches of two spans from start in which all looked-up terms of a window stand; a span is
    the window and the slack. Places are dealt to cells of a span and entered in the cell before too, so that any span lies
    whole in one cell's stretch, whatever the text's length."""
    w, least = _masked(index)
    span = small(least.select("key", (F.col("size") + slack).alias("span")), BROADCAST_ROWS)
    rows = index.postings.join(small(index.probes.join(span, "key"), BROADCAST_ROWS), "term").withColumn("cell", F.floor(F.col("place") / F.col("span")).cast("int"))
    met = (
        rows.select("key", "id", "body", F.explode(F.array("cell", F.col("cell") - 1)).alias("cell"), _bit(F.col("q")).alias("bit"))
        .groupBy("key", "id", "body", "cell").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("met"))
    )
    met = met.join(small(least, BROADCAST_ROWS), "key").where(F.col("met") >= F.col("least"))
    found = met.join(small(w.select("key", "words", "mask"), BROADCAST_ROWS), "key")
    hit = found.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return hit.select("id", "body", F.greatest(F.lit(0), F.col("cell") * (F.col("size") + slack)).alias("start"), "words").distinct()


def _held(index: Index, found: DataFrame, slack: int = 0) -> DataFrame:
    """Of candidates (id, body, start, words, near) those that hold: the window stands at start, or (near is the slack, else null)
    all its words stand, in any order, within its length and the slack in the stretch of two such spans from start. A candidate is
    joined to a cell of its text, CELL words and as many more as a stretch takes, so that no row grows with a text."""
    reach = 2 * (index.size + slack)
    asked = materialize(found.withColumn("cell", F.floor(F.col("start") / CELL).cast("int")).distinct(), "starts")

    def same(a: str, b: str, *more: str) -> Column:
        return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.body") == F.col(f"{b}.body")) & F.expr(" AND ".join(["true", *(f"{a}.{c} = {b}.{c}" for c in more)]))

    # Texts and cells without a candidate stay where they are, as long as those with one are counted to be few.
    texts = index.words.alias("d").join(small(asked.select("id", "body").distinct(), BROADCAST_ROWS).alias("s"), same("d", "s"), "left_semi").alias("d")
    cells = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n_words") - 1) / CELL), F.lit(0)).cast("int")), lambda c: F.struct(c.alias("cell"), F.array_join(F.slice("w", c * CELL + 1, CELL + reach), " ").alias("line")))
    held = texts.select("id", "body", "n_words", _words().alias("w")).select("id", "body", F.explode(cells).alias("x")).select("id", "body", "x.*").alias("h")
    held = held.join(small(asked.select("id", "body", "cell").distinct(), BROADCAST_ROWS).alias("s"), same("h", "s", "cell"), "left_semi").alias("h")
    each = held.join(asked.alias("c"), same("h", "c", "cell")).select("c.id", "c.body", "start", "words", "near", (F.col("start") - F.col("c.cell") * CELL + 1).alias("at"), F.split("line", " ").alias("w"))
    exact = F.slice("w", F.col("at"), F.size("words")) == F.col("words")
    span = F.size("words") + F.col("near")
    stretch = F.slice("w", F.col("at"), 2 * span)
    spans = F.transform(F.sequence(F.lit(1), span + 1), lambda s: F.slice(stretch, s, span))
    all_in = F.exists(spans, lambda x: F.size(F.array_except("words", x)) == 0)
    return each.where(F.when(F.col("near").isNull(), exact).otherwise(all_in)).select("id", "body", "start", "words", "near").distinct()


def occurrences(index: Index) -> DataFrame:
    """(id, body, start, words): exact places of whole windows, by document id and text."""
    return _held(index, candidates(index).withColumn("near", F.lit(None).cast("int"))).drop("near")


def proximity_matches(index: Index, slack: int = SLACK) -> DataFrame:
    """(id, body, words): windows whose words all stand, in any order, within the window's length plus slack. Exact matches are
    among them."""
    return _held(index, near_candidates(index, slack).withColumn("near", F.lit(slack)), slack).select("id", "body", "words").distinct()


def _items_of(index: Index, found: DataFrame) -> DataFrame:
    """(id, body, item): the items whose windows were found."""
    owners = index.windows.select("key", "words").distinct().join(index.items.select("key", F.coalesce("item", F.lit("")).alias("item")), "key").select("words", "item").distinct()
    return found.select("id", "body", "words").distinct().join(small(owners, BROADCAST_ROWS), "words").select("id", "body", "item").distinct()


def report(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """A row per document: id, body, n_words, n_hit, n_items, item_ids (sorted), contaminated, and n_near_items: items with
    a window whose words all stand, in any order, within the window's length plus slack."""
    index = build_index(docs, items, id_col, text_col, item_id, item_text, size)
    asked = candidates(index).withColumn("near", F.lit(None).cast("int")).unionByName(near_candidates(index, slack).withColumn("near", F.lit(slack)))
    held = materialize(_held(index, asked, slack), "occurrences")
    found = held.where("near IS NULL")
    spans = found.select("id", "body", "start", F.size("words").alias("n")).distinct().groupBy("id", "body").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))
    union = F.aggregate(
        "spans",
        zero,
        lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("hit"), F.greatest(a["end"], s["start"] + s["n"]).alias("end")),
        lambda a: a["hit"],
    )
    hit = spans.select("id", "body", union.alias("n_hit"))
    ids = _items_of(index, found).groupBy("id", "body").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    near = _items_of(index, held.where("near IS NOT NULL")).groupBy("id", "body").agg(F.count("*").alias("n_near_items"))
    # Every exact match is a proximity match, so near has all rows of the others.
    key = lambda df, i: df.withColumnsRenamed({"id": f"id{i}", "body": f"body{i}"})
    same = lambda i: F.col("id").eqNullSafe(F.col(f"id{i}")) & (F.col("body") == F.col(f"body{i}"))
    all_hits = near.join(key(hit, 1), same(1), "left").join(key(ids, 2), same(2), "left").select("id", "body", "n_hit", "item_ids", "n_near_items")
    both = materialize(all_hits, "hits").alias("h")
    sizes = materialize(index.words.select("id", "body", "n_words"), "sizes").alias("d")
    index.drop()
    drop(held)
    out = sizes.join(both, F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.body") == F.col("h.body")), "left")
    none = F.array().cast("array<string>")
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_hit", "n_near_items")}
    return out.select("d.id", "d.body", "n_words", zeros["n_hit"].alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), zeros["n_near_items"].alias("n_near_items")).withColumns(
        {"n_items": F.size("item_ids").cast("long"), "contaminated": F.col("n_hit") > 0}
    )


def clean(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", size: int = WINDOW) -> DataFrame:
    """The rows of documents that hold no window, with all their columns."""
    body = fresh(docs, "body_hash")
    index = build_index(docs, items, id_col, text_col, item_id, item_text, size)
    bad = materialize(occurrences(index).select("id", "body").distinct(), "contaminated")
    index.drop()
    marked = docs.withColumn(body, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("d")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("r.id")) & (F.col(f"d.`{body}`") == F.col("r.body"))
    return marked.join(small(bad, BROADCAST_ROWS).alias("r"), same, "left_anti").drop(body)
