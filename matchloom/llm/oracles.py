"""DuckDB SQL for the queries that SQL can express; the others are held against brute force in the tests."""

_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '{_TERM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW.format('text')}, '{_TERM}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[s : s + 9] AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)
),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
firsts AS (SELECT DISTINCT words[1] AS f FROM win),
grams AS (SELECT doc_id, p, w[p] AS f, w[p : p + 9] AS g FROM pos WHERE w[p] IN (SELECT f FROM firsts)),
occ AS (
  SELECT doc_id, p, len(words) AS n, item_id FROM grams JOIN win ON f = words[1] AND g[1 : len(words)] = words
),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY doc_id
),
-- Near: all words of a window within its length plus 5. Looked for around its rarest word, or around none if one is missing.
cnt AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) WHERE t IN (SELECT unnest(words) FROM win) GROUP BY t),
rare AS (
  SELECT words, arg_min(t, (coalesce(n, 0), t)) AS a FROM (SELECT words, unnest(words) AS t FROM (SELECT DISTINCT words FROM win)) LEFT JOIN cnt USING (t)
  GROUP BY words HAVING count(*) = count(n)
),
around AS (SELECT doc_id, w, p, w[p] AS a FROM pos WHERE w[p] IN (SELECT a FROM rare)),
near AS (
  SELECT DISTINCT doc_id, words FROM around JOIN rare USING (a)
  WHERE len(list_filter(range(greatest(1, p - len(words) - 4), p + 1), lambda s: list_has_all(w[s : s + len(words) + 4], words))) > 0
),
nearby AS (SELECT doc_id, count(DISTINCT coalesce(item_id::VARCHAR, '')) AS n_near_items FROM near JOIN win USING (words) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN nearby USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT page_id, strlen(body)::BIGINT AS bytes, sha1(body) AS h FROM p),
r AS (SELECT h, max(page_id) AS best FROM s GROUP BY h),
b AS (
  SELECT h, array_to_string(list_transform(range(1, 41), lambda k: printf('%04d', ['0', '1', '10', '11', '100', '101', '110', '111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(h, k, 1))]::INT)), '') AS bits
  FROM r
),
c AS (
  SELECT h, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT
    + 4 * substr(bits, 5 * k + 3, 1)::INT + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT)::BIGINT, 1)), '') AS digest
  FROM b
)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM s JOIN r USING (h) JOIN c USING (h)
"""

_UNIT = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
    {_UNIT.format("concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')), 'mix')")} AS u
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
c AS (
  -- A source is at its limit if filling those of smaller limits for their weight leaves it at least that much.
  SELECT *, (SELECT 1.5::DOUBLE * sum(source_size) FROM o) AS total,
    coalesce(sum(2 * source_size) OVER b, 0) AS below, sum(weight) OVER (ORDER BY ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM o WINDOW b AS (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
f AS (SELECT *, (total - below) * weight / rest > 2 * source_size AS capped FROM c),
t AS (
  SELECT source, source_size, n, CASE WHEN capped THEN (2 * source_size)::DOUBLE
    ELSE (total - coalesce((SELECT sum(2 * source_size) FROM f WHERE capped), 0)) * weight / (SELECT sum(weight) FROM f WHERE NOT capped) END AS target
  FROM f
),
k AS (
  SELECT d.doc_id, d.source, size, source_size, target, u, floor(log2(size + 1.0) * 8) AS cls,
    floor(u * greatest(1, ceil(n / 2000.0))) AS part
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, part, size, u, doc_id) AS place,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, {_UNIT.format("concat_ws('|', coalesce(source, ''), 'offset')")} AS o FROM k)
SELECT doc_id, size, source_size, target, ((floor(place * rate + o) - floor((place - 1) * rate + o)) * size)::BIGINT AS taken FROM p
"""

QUALITY = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
),
base AS (
  SELECT doc_id, source, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}')))))::BIGINT AS n_dup_lines
  FROM d
),
grams AS (SELECT doc_id, p, w[p : p + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
often AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
reps AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM grams JOIN often USING (doc_id, g)) GROUP BY doc_id
),
l AS (
  SELECT doc_id, source, text, place, x, regexp_extract_all(lower(regexp_replace(x, '[0-9]+', '0', 'g')), '{_WORD}') AS t
  FROM (SELECT doc_id, source, text, unnest(lines) AS x, generate_subscripts(lines, 1) AS place FROM d)
),
k AS (SELECT doc_id, source, text, place, x, array_to_string(t, ' ') AS line, len(t) AS n FROM l),
freq AS (SELECT source, line FROM k WHERE n > 0 GROUP BY source, line HAVING count(DISTINCT text) > 20),
marked AS (SELECT k.*, freq.line IS NOT NULL AS often FROM k LEFT JOIN freq ON k.n > 0 AND k.source IS NOT DISTINCT FROM freq.source AND k.line = freq.line),
cut AS (
  SELECT doc_id, coalesce(sum(n) FILTER (often), 0)::BIGINT AS n_boilerplate,
    greatest(coalesce(sum(length(x) + 1) FILTER (NOT often), 0) - 1, 0)::BIGINT AS clean_chars, md5(coalesce(string_agg(md5(x), ',' ORDER BY place) FILTER (NOT often), '')) AS clean_md5
  FROM marked GROUP BY doc_id
),
j AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_boilerplate, clean_chars, clean_md5
  FROM base LEFT JOIN reps USING (doc_id) JOIN cut USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND NOT (n_boilerplate > 0 AND (n_words - n_boilerplate < 10 OR 100 * (n_words - n_boilerplate) < 30 * n_words)) AS kept
FROM j
"""


def _vector_codes(rounds: int = 4) -> str:
    """Lloyd's rounds written out: c0 to c4 are the codebooks, a0 to a4 the parts' nearest entries in them."""
    assigned = """
a{k} AS (
  SELECT vec_id, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT vec_id, p, x, e, (xx - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT AS d FROM parts JOIN c{k} USING (p)) GROUP BY vec_id, p
)"""
    moved = """
s{k} AS (
  SELECT p, e, list(floor_div ORDER BY j)::DOUBLE[] AS c FROM (
    SELECT p, e, j, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS floor_div
    FROM (SELECT p, e, j, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(x)::BIGINT AS v, generate_subscripts(x, 1) AS j FROM a{k}) GROUP BY p, e, j)
  ) GROUP BY p, e
),
c{n} AS (SELECT p, e, coalesce(s{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN s{k} USING (p, e))"""
    steps = [x for k in range(rounds) for x in (assigned.format(k=k), moved.format(k=k, n=k + 1))] + [assigned.format(k=rounds)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cut AS (SELECT vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)),
parts AS (SELECT *, list_inner_product(x, x) AS xx FROM cut),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
{",".join(steps)},
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
b AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS j FROM c{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN kept USING (vec_id), b
"""


# h is the conversation id's crc32, bit by bit, modulo 9.
CONVERSATION_TRIE = """
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS whole
  FROM conversations WHERE conv_id IS NOT NULL
),
l AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, sha256(whole)) AS xs FROM t GROUP BY c),
b AS (
  SELECT c, xs, c - c % 5 AS base, xor(list_reduce(
    [4294967295] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_transform(range(0, 8), lambda k: (ascii(x) >> k::INT) & 1)))::BIGINT[],
    lambda r, bit: xor(r >> 1, CASE WHEN xor(r & 1, bit) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 9 AS h
  FROM l
),
s AS (SELECT b.c, list_concat(coalesce(l.xs[1 : h], []), b.xs[h + 1 :]) AS xs FROM b LEFT JOIN l ON l.c = b.base),
p AS (SELECT c, xs[1 : d] AS k, d, len(xs) AS n FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM s)),
node AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (max(n) = d)::BIGINT AS leaf, (count(*) - 1) * coalesce(strlen(k[d].text), 0) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY d, k
),
kids AS (SELECT d - 1 AS d, k[1 : d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
sums AS (SELECT d, k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT e AS d, k[1 : e] AS k, leaf, saved FROM (SELECT k, leaf, saved, unnest(range(0, d + 1)) AS e FROM node)) GROUP BY d, k)
SELECT a.conv_id, a.d::BIGINT AS depth, up.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, a.ends_sha256
FROM node a JOIN sums USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN node up ON up.d = a.d - 1 AND up.k = a.k[1 : a.d - 1]
"""

ORACLES = {"op1_decontamination": DECONTAMINATION, "op4_warc": WARC, "op6_mixing": MIXING, "op8_quality": QUALITY, "op11_vector_codes": _vector_codes(), "op12_conversation_trie": CONVERSATION_TRIE}
