"""DuckDB SQL of the queries that SQL can express.

Not expressed: the ones that need a tokenizer (1, 2), a trained model (3, 6), XXH64 (4, 9 for its seeded order, 11 for its sample) or
a parser of pages (10). Tests hold those against brute-force versions.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]+"

OP5 = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
),
positions AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM texts
),
runs AS (
  SELECT doc_id, i,
    CASE WHEN count(*) OVER three = 3 THEN string_agg(word, ' ') OVER three END AS run3,
    CASE WHEN count(*) OVER eight = 8 THEN string_agg(word, ' ') OVER eight END AS run8,
    CASE WHEN count(*) OVER longest = 61 THEN string_agg(word, ' ') OVER longest END AS run61
  FROM positions
  WINDOW three AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
    eight AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING),
    longest AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING)
),
repeated AS (
  SELECT doc_id, i,
    run3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, run3) > 1 AS again3,
    run8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, run8) > 1 AS again8,
    run61 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, run61) > 1 AS again61
  FROM runs
),
covered AS (
  SELECT doc_id, i, again61,
    bool_or(again3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS in3,
    bool_or(again8) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS in8
  FROM repeated
),
counts AS (
  SELECT doc_id, count(*) FILTER (in3) AS in3, count(*) FILTER (in8) AS in8, bool_or(again61) AS too_long
  FROM covered GROUP BY doc_id
),
measures AS (
  SELECT doc_id,
    len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))))::BIGINT AS n_dup_lines,
    coalesce(in3, 0)::BIGINT AS n_repeat_words,
    coalesce(in8, 0) AS in8,
    coalesce(too_long, false) AS too_long
  FROM texts LEFT JOIN counts USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * in8 > 30 * n_words OR too_long) AS kept
FROM measures
"""

OP7 = rf"""
WITH digests AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
    sha256(regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER best AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER best AS kept,
  text_sha256
FROM digests
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

OP8 = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
),
first_of AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
  FROM payloads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM first_of
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP12 = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
),
runs AS (
  SELECT lang, m.n AS n, array_to_string(words[i + 1 : i + m.n], ' ') AS phrase
  FROM (SELECT lang, words, unnest(range(len(words))) AS i FROM pieces), (VALUES (1), (2), (3), (4)) AS m(n)
  WHERE i + m.n <= len(words)
),
counted AS (SELECT lang, n, phrase, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE n = 1 GROUP BY lang),
candidates AS (SELECT lang, n AS words, phrase, string_split(phrase, ' ') AS parts, f AS a FROM counted WHERE n > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
    ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.parts[1 : c.k], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.parts[c.k + 1 : c.words], ' ')
),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inner_runs AS (
  SELECT c.lang, array_to_string(c.parts[i + 1 : i + m.n], ' ') AS phrase, max(c.a) AS longer
  FROM (SELECT *, unnest(range(words)) AS i FROM candidates) c, (VALUES (2), (3)) AS m(n)
  WHERE m.n < c.words AND i + m.n <= c.words
  GROUP BY ALL
),
left_over AS (
  SELECT s.* FROM lowest s LEFT JOIN inner_runs o USING (lang, phrase)
  WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * s.a
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over
)
SELECT lang, rank, phrase, a, l, r, t.n AS n, score
FROM ranked JOIN totals t USING (lang) WHERE rank <= 2000
"""

_FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: CRC-32 from its polynomial: the table of the 256 bytes, then a fold over the bytes of a word.
OP13 = rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
    range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab
),
corpus AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_FEATURE_WORD}') AS words
  FROM documents
),
target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_FEATURE_WORD}')) AS word
  FROM benchmark
),
corpus_words AS (SELECT row, unnest(words) AS word FROM corpus),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM corpus_words UNION ALL SELECT word FROM target)),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM vocabulary, crc_table
),
s AS (SELECT bucket, count(*) AS n FROM corpus_words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS all_t),
gains AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (all_s + 10000)
    / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums
),
weights AS (
  SELECT row, sum(gain)::BIGINT AS weight FROM corpus_words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row
),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM corpus LEFT JOIN weights USING (row)
),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place
  FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_repetition_rules": OP5,
        "op7_exact_dedup": OP7,
        "op8_warc": OP8,
        "op12_collocations": OP12,
        "op13_importance_resampling": OP13,
    }
