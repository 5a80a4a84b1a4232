"""The same results in SQL for DuckDB, for the queries that SQL can express."""

from __future__ import annotations

from funnelry.llm import mixing

SPACED = r"[^\x20\x09-\x0D]+"
LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A-Z only; other letters stay as they are.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{SPACED}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * pairs.n >= 85 * (a.n + b.n - pairs.n)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION SELECT edges.y, reach.root FROM reach JOIN edges ON edges.x = reach.id
), named AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN named ON id = doc_id
"""

#: Text as hexadecimal digits, in pieces of 500 bytes and the 49 that follow.
OP4 = """
WITH docs AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n_bytes FROM documents
), pieces AS (
  SELECT doc_id, n_bytes, base, substr(h, 2 * base + 1, 1098) AS piece
  FROM (SELECT *, unnest(range(0, n_bytes, 500)) AS base FROM docs)
), places AS (
  SELECT doc_id, n_bytes, base + k AS p, substr(piece, 2 * k - 1, 2) AS byte,
    CASE WHEN base + k <= n_bytes - 49 THEN substr(piece, 2 * k - 1, 100) END AS string
  FROM (SELECT *, unnest(range(1, least(500, n_bytes - base) + 1)) AS k FROM pieces)
), least AS (
  SELECT string, min(doc_id) AS first_id FROM places WHERE string IS NOT NULL GROUP BY string
), marked AS (
  SELECT places.*, coalesce(first_id < doc_id, false) AS starts FROM places LEFT JOIN least USING (string)
), covered AS (
  SELECT *, max(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM marked
), edged AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM covered
), summed AS (
  SELECT doc_id, count_if(gone)::BIGINT AS n_removed, count_if(begins)::BIGINT AS n_spans,
    coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept
  FROM edged GROUP BY doc_id
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN summed USING (doc_id)
"""

OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l'))
    + length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), chr(10), '\n'))
    + length('### ') + 1 + length('</turn>') + 1 AS chars,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS before
  FROM rows
), talks AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(chars)::BIGINT AS formatted_chars,
    bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'),
      ('user', 'assistant'), ('assistant', 'user')))
      AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars,
  sha256(learned) AS loss_sha256, formatted_chars, valid
FROM talks
"""

OP3 = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT digest, min(page_id) AS first_id FROM rows GROUP BY digest
), named AS (
  SELECT *, CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
  FROM rows JOIN firsts USING (digest)
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM named
"""

#: c1, c2 and c3 count a word alone and after one and two words, in all other documents.
OP5 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{SPACED}') AS w
  FROM documents
), places AS (
  SELECT r, len(w) AS n, k, w[k] AS g1, CASE WHEN k > 1 THEN array_to_string(w[k - 1:k], ' ') END AS g2,
    CASE WHEN k > 2 THEN array_to_string(w[k - 2:k], ' ') END AS g3
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM docs)
), counted AS (
  SELECT r, n, k, count(*) OVER () - n AS elsewhere,
    count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY g1, r) AS c1,
    CASE WHEN k > 1 THEN count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY g2, r) ELSE 0 END AS c2,
    CASE WHEN k > 2 THEN count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY g3, r) ELSE 0 END AS c3
  FROM places
), histories AS (
  SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY k) AS h1, lag(c2) OVER (PARTITION BY r ORDER BY k) AS h2
  FROM counted
), scored AS (
  SELECT r, CASE WHEN c3 > 0 THEN ln(c3 / h2) WHEN c2 > 0 THEN ln(c2 / h1) + CASE WHEN k > 2 THEN ln(0.4) ELSE 0 END
    ELSE ln(greatest(c1, 1) / greatest(elsewhere, 1)) + ln(0.4) * (least(k, 3) - 1) END AS score,
    CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END < least(k, 3) AS backed_off
  FROM histories
), summed AS (
  SELECT r, fsum(score) AS score, count_if(backed_off)::BIGINT AS n_backed_off FROM scored GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0), 6) AS log_score,
  coalesce(n_backed_off, 0)::BIGINT AS n_backed_off, round(score / len(w), 6) AS mean_log_score
FROM docs LEFT JOIN summed USING (r)
"""

OP6 = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{LETTERED}') AS words
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{LETTERED}') AS words
  FROM benchmark
), sized AS (
  SELECT DISTINCT item_id, words, least(len(words), 13) AS m FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(words[k:k + m - 1], ' ') AS string
  FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS k FROM sized)
), lengths AS (SELECT DISTINCT m FROM windows
), places AS (
  SELECT doc_id, m, k, array_to_string(words[k:k + m - 1], ' ') AS string
  FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS k FROM docs, lengths WHERE len(words) >= m)
), hits AS (
  SELECT doc_id, k, m, item_id FROM places JOIN windows USING (m, string)
), covered AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + m)) AS w FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP9 = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER ranks)::INTEGER AS rank, vec_id, score FROM scores
WINDOW ranks AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER ranks <= 20
"""

#: Documents with their size, source number and place in the draw, and the target of each source.
MIXTURE = rf"""
docs AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '{SPACED}'))::BIGINT AS size,
    ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 6))::BIGINT
      AS place
  FROM {{docs}}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
    [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS weight
  FROM docs GROUP BY source
), ordered AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(cap) OVER lower, 0)::BIGINT AS given, (sum(weight) OVER upper)::BIGINT AS rest,
    row_number() OVER (ORDER BY cap / weight, source) AS k
  FROM sources
  WINDOW lower AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    upper AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT total - given AS over_, rest FROM ordered WHERE cap >= weight * ((total - given) / rest)
  ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN cap < weight * (over_ / rest_) THEN cap::DOUBLE
    ELSE (weight * over_)::DOUBLE / rest_ END AS target
  FROM sources, (SELECT over_, rest AS rest_ FROM level)
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM targets
), drawn AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
    sum(size) OVER (PARTITION BY d.source ORDER BY place) AS upto,
    sum(size) OVER (PARTITION BY d.source, place) AS words
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), mixed AS (
  SELECT *, CASE WHEN source_size > 0 THEN whole
      + CASE WHEN upto <= need OR (upto - words <= need AND words - (need - (upto - words)) < need - (upto - words))
        THEN 1 ELSE 0 END ELSE 0 END AS repetitions
  FROM drawn
)
"""

OP10 = f"""
WITH {MIXTURE.format(docs="documents")}
SELECT doc_id, size, source_size, target, (size * repetitions)::BIGINT AS taken,
  repetitions::BIGINT AS repetitions
FROM mixed
"""


#: The checksum of a list of bytes; `crc` has the table of its 256 remainders.
REMAINDERS = """
crc AS (
  SELECT list(list_reduce([i] || range(8), lambda s, k: xor(s >> 1, 3988292384 * (s & 1))) ORDER BY i) AS rest
  FROM (SELECT unnest(range(256)) AS i)
)
"""
CRC32 = "xor(list_reduce([4294967295::BIGINT] || {0}, lambda s, b: xor(s >> 8, rest[(xor(s, b) & 255) + 1])), 4294967295)"

OP12 = f"""
WITH {REMAINDERS}, slim AS (
  SELECT conv_id, turn, sha256(length(role) || ':' || role || text)[1:32] AS mark,
    len(regexp_extract_all(text, '{SPACED}')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
  WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(mark ORDER BY turn NULLS FIRST, mark) AS marks,
    list(words ORDER BY turn NULLS FIRST, mark) AS words,
    {CRC32.format("list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)")} % 4 AS h
  FROM slim, crc GROUP BY conv_id, rest
), whole AS (
  SELECT o.conv_id, coalesce(p.marks[1:o.h], []) || o.marks[o.h + 1:] AS marks,
    coalesce(p.words[1:o.h], []) || o.words[o.h + 1:] AS words
  FROM own o LEFT JOIN own p ON p.conv_id = o.conv_id - o.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, array_to_string(marks[1:d], '') AS key, coalesce(words[d], 0) AS w, d = len(marks) AS ends
  FROM (SELECT *, unnest(range(0, len(marks) + 1)) AS d FROM whole)
), nodes AS (
  SELECT key, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key
), children AS (
  SELECT key[1:32 * (depth - 1)] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)
), below AS (
  SELECT key[1:32 * i] AS key, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM counted) GROUP BY 1
)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below USING (key)
  LEFT JOIN nodes p ON c.depth > 0 AND p.key = c.key[1:32 * (c.depth - 1)]
"""

OP13 = rf"""
WITH RECURSIVE {REMAINDERS}, runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  GROUP BY doc_id, run
), lowered AS (
  SELECT doc_id, {LOWER.format("run")} AS run, sum(n) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT *, {CRC32.format("""flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))""")} AS h
  FROM lowered, crc
), changed AS (
  SELECT n, CASE WHEN h % 97 <> 0 THEN run
    ELSE substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) END AS word
  FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word AS x, a.n AS nx, b.word AS y, b.n AS ny FROM shorter a JOIN shorter b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN shorter b ON a.word = b.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN shorter b ON a.word = b.rest
), near AS (
  SELECT x AS word, count(*) AS n_near, max(ny) AS top, arg_min(y, (-ny, hex(y))) AS best FROM pairs GROUP BY x
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN best END AS form,
    CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM words LEFT JOIN near USING (word)
), chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL
), ends AS (
  SELECT chain.word, chain.at AS root FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


def all_oracles() -> dict[str, str]:
    return {
        "op1_near_duplicates": OP1,
        "op2_chat_format": OP2,
        "op3_warc_archive": OP3,
        "op4_repeated_passages": OP4,
        "op5_backoff_scores": OP5,
        "op6_decontamination": OP6,
        "op9_threshold_topk": OP9,
        "op10_mixture": OP10,
        "op12_prefix_trie": OP12,
        "op13_spelling_variants": OP13,
    }
