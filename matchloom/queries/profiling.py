"""Profiler analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scripts
from ..operators import profile
from ..operators.joins import POS
from ..sources.files import spread
from .base import Query, chars, ratio_sql, read

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _docs(spark, d):
    return spread(read(spark, d, "documents").select("doc_id", "text", "lang", F.col("doc_id").alias(POS)))


def _toks(spark, d, tier="clean"):
    return profile.token_table(_docs(spark, d), ["text"], [tier])


def _split(tier):
    text = "regexp_replace(lower(text), '[,.;:]', '', 'g')" if tier == "clean" else "text"
    return f"toks AS (SELECT doc_id, list_filter(string_split({text}, ' '), lambda x: x <> '') AS w, len(string_split(text, ' ')) AS total FROM documents), flat AS (SELECT doc_id, total, unnest(w) AS tok, unnest(range(1, len(w) + 1)) AS pos FROM toks)"


@register(f"WITH {_split('clean')} SELECT tok, count(*) AS count FROM flat GROUP BY tok ORDER BY count DESC, tok LIMIT 50")
def profile_top_tokens(spark, d):
    return profile.top_tokens(_toks(spark, d), 50)


def _grams(n):
    return f"""WITH {_split('raw')}, g AS (SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS ngram FROM toks WHERE len(w) >= {n})
      SELECT ngram, count(*) AS count FROM g GROUP BY ngram ORDER BY count DESC, ngram LIMIT 50"""


@register(_grams(2))
def profile_bigrams(spark, d):
    return profile.ngrams(_docs(spark, d), "text", 2)


@register(_grams(3))
def profile_trigrams(spark, d):
    return profile.ngrams(_docs(spark, d), "text", 3)


@register(f"WITH {_split('clean')} SELECT tok FROM flat GROUP BY tok HAVING count(*) = 1 ORDER BY tok LIMIT 50")
def profile_singletons(spark, d):
    return profile.singletons(_toks(spark, d))


@register(f"WITH {_split('clean')} SELECT tok, count(DISTINCT doc_id) AS count FROM flat GROUP BY tok")
def profile_doc_freq(spark, d):
    return profile.document_frequency(_docs(spark, d), "text")


@register(f"""WITH {_split('clean')}, c AS (SELECT tok, count(DISTINCT doc_id) AS count FROM flat GROUP BY tok ORDER BY count DESC, tok LIMIT 60), n AS (SELECT count(text) AS rows FROM documents)
  SELECT tok, round(count / rows, 3) AS frequency, count, tok IN ({", ".join(f"'{w}'" for w in profile.KNOWN_STOPWORDS['name'])}) AS known FROM c, n
  WHERE count / rows >= 0.15 OR tok IN ({", ".join(f"'{w}'" for w in profile.KNOWN_STOPWORDS['name'])}) ORDER BY count DESC, tok LIMIT 20""")
def profile_stopwords(spark, d):
    return profile.suggest_stopwords(_docs(spark, d), "text")


@register(f"""WITH {_split('raw')}, c AS (SELECT tok, count(*) AS n FROM flat GROUP BY tok), k AS (SELECT *, regexp_replace(lower(tok), '[^a-z0-9]', '', 'g') AS canonical FROM c)
  SELECT canonical, string_agg(tok || '=' || n::VARCHAR, ' ' ORDER BY n DESC, tok) AS variants, sum(n)::BIGINT AS total FROM k WHERE canonical <> '' AND regexp_full_match(tok, '[ -~]*') GROUP BY canonical HAVING count(*) > 1""")
def profile_aliases(spark, d):
    ascii_only = _toks(spark, d, "raw").where(F.col("tok").rlike("^[ -~]*$"))
    found = profile.suggest_aliases(ascii_only, None)
    return found.select("canonical", F.array_join(F.transform("variants", lambda v: F.concat(v["raw"], F.lit("="), v["count"])), " ").alias("variants"), "total")


@register(f"""WITH {_split('clean')}, c AS (SELECT tok, count(*) AS n FROM flat GROUP BY tok ORDER BY n DESC, tok LIMIT 200),
  p AS (SELECT a.tok AS token1, b.tok AS token2, a.n AS count1, b.n AS count2, {chars('a.tok')} AS ca, {chars('b.tok')} AS cb FROM c a JOIN c b ON length(b.tok) - length(a.tok) BETWEEN 0 AND 2 AND (length(a.tok) < length(b.tok) OR a.tok < b.tok)),
  s AS (SELECT token1, token2, {ratio_sql('ca', 'cb')} AS similarity, count1, count2 FROM p) SELECT token1, token2, round(similarity, 6) AS similarity, count1, count2 FROM s WHERE similarity >= 85""")
def profile_near_dupes(spark, d):
    return profile.near_duplicates(_toks(spark, d), n=None).withColumn("similarity", F.round("similarity", 6))


@register(f"""WITH {_split('clean')}, c AS (SELECT CASE WHEN pos = 1 THEN 'first' END AS place, tok FROM flat UNION ALL SELECT CASE WHEN pos = total THEN 'last' END, tok FROM flat
    UNION ALL SELECT CASE WHEN pos > 1 AND pos < total AND total > 2 THEN 'middle' END, tok FROM flat), n AS (SELECT place, tok, count(*) AS count FROM c WHERE place IS NOT NULL GROUP BY ALL)
  SELECT place, tok, count FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY count DESC, tok) AS r FROM n) WHERE r <= 30""")
def profile_positions(spark, d):
    return profile.positions(_toks(spark, d))


@register(f"WITH {_split('clean')} SELECT min(length(tok))::INTEGER AS min, max(length(tok))::INTEGER AS max, round(avg(length(tok)), 2) AS mean, median(length(tok)) AS median FROM flat")
def profile_lengths(spark, d):
    return profile.lengths(_toks(spark, d))


@register(f"WITH {_split('clean')} SELECT length(tok)::INTEGER AS length, count(*) AS count FROM flat GROUP BY ALL")
def profile_length_histogram(spark, d):
    return profile.length_histogram(_toks(spark, d))


@register(rf"""WITH {_split('raw')}, c AS (SELECT count(*) AS total_tokens, count(*) FILTER (regexp_matches(tok, '^\d+\.?\d*$')) AS numeric, count(*) FILTER (regexp_matches(tok, '^[A-Za-z]+$')) AS alpha FROM flat)
  SELECT *, total_tokens - numeric - alpha AS mixed, round(numeric / total_tokens * 100, 1) AS numeric_pct FROM c""")
def profile_numeric_ratio(spark, d):
    return profile.numeric_ratio(_toks(spark, d, "raw"))


def _quality(c):
    return f"SELECT '{c}' AS column, count(*) AS total_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) + (count(*) > count({c}))::INT AS unique_count, min(length({c}))::INTEGER AS min_length, max(length({c}))::INTEGER AS max_length, round(avg(length({c})), 1) AS mean_length FROM t"


@register(f"WITH t AS (SELECT CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang, source FROM documents) {_quality('lang')} UNION ALL {_quality('source')}")
def profile_quality(spark, d):
    docs = read(spark, d, "documents").select(F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"), "source")
    return profile.quality(docs, ["lang", "source"]).select("column", "total_rows", "null_count", "unique_count", "min_length", "max_length", "mean_length")


def _class(spans):
    return "(" + " OR ".join(f"cp BETWEEN {s} AND {e}" for s, e in spans) + ")"


_SCRIPTS = [k for k in scripts.RANGES if k not in scripts.COMMON]


@register(f"""WITH v AS (SELECT doc_id, regexp_replace(text, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g') AS t FROM documents), u AS (SELECT doc_id, unnest(string_split(t, '')) AS ch FROM v WHERE t <> ''),
  c AS (SELECT doc_id, unicode(ch) AS cp FROM u), k AS (SELECT doc_id, CASE {" ".join(f"WHEN {_class(s)} THEN '{n}'" for n, s in scripts.RANGES.items())} ELSE 'unknown' END AS kind FROM c),
  cells AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{n}') AS {n}" for n in [*scripts.RANGES, 'unknown'])} FROM k GROUP BY doc_id)
  SELECT count(*) AS total_cells, {", ".join(f"sum({n})::BIGINT AS {n}" for n in [*scripts.RANGES, 'unknown'])}, count(*) FILTER (unknown > 0) AS cells_with_unknown,
    count(*) FILTER ({" + ".join(f"({n} > 0)::INT" for n in _SCRIPTS)} > 1) AS mixed_script_cells FROM cells""")
def profile_unicode(spark, d):
    return profile.unicode_profile(_docs(spark, d), "text")


@register("""SELECT * FROM (VALUES ('c_name', 'id'), ('c_mktsegment', 'freetext'), ('order_date', 'date'), ('address', 'address'), ('company', 'name')) t(column_name, kind)""")
def profile_types(spark, d):
    c = read(spark, d, "customer")
    df = c.select(
        "c_name", "c_mktsegment", F.lit("2001-02-03 04:05").alias("order_date"), F.concat("c_custkey", F.lit(" Main Street")).alias("address"), F.concat("c_mktsegment", F.lit(" Ltd.")).alias("company"),
    )
    return spark.createDataFrame([(n, profile.column_type(df, n)) for n in df.columns], "column_name string, kind string")
