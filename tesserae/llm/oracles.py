"""The contracts that SQL can express in full, restated for DuckDB."""

from __future__ import annotations

import string

from .quality_rules import RULES, STOP_WORDS
from .warc import BASE32

_WORD = r"[^\x20\x09-\x0D]"


def _rejected() -> str:
    cases = []
    for r in RULES:
        over, under = r.ratio.split(" / ")
        ratio = f"({over}::DOUBLE / nullif({under}, 0))"
        bounds = [f"{ratio} < {r.low}"] * (r.low > float("-inf")) + [f"{ratio} > {r.high}"] * (r.high < float("inf"))
        cases.append(f"CASE WHEN n_words >= {r.words} AND ({' OR '.join(bounds)}) THEN '{r.name}' END")
    return f"concat_ws(',', {', '.join(cases)})"


QUALITY_RULES = f"""
WITH numbered AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), split AS MATERIALIZED (
  SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls
  FROM numbered
), windows AS (
  SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS words FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM split WHERE len(ws) > 8)
), repeated AS MATERIALIZED (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, words) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, range(8) AS steps(k) GROUP BY r
), counted AS MATERIALIZED (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(t) - length(replace(t, '!', '')) AS n_bangs,
    len(list_filter(ws, lambda w: length(w) <= 5 AND lower(w) IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stops,
    len(ls) AS n_lines, len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis,
    len(list_filter(ls, lambda x: substr(x, 1, 1) IN ('-', '*', '•'))) AS n_bullets
  FROM split LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_rejected()} AS rejected_by FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM judged
"""

_LETTERS = ", ".join(f"substr('{BASE32}', ((('0x' || substr(digest, {5 * i + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31)::INT + 1, 1)" for i in range(8) for k in range(4))
WARC = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
held AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS holder FROM payloads)
SELECT page_id, payload_bytes, concat({_LETTERS}) AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM held
"""

#: Sets that share four fifths of the larger one share one of their rarest fifth, and one more, in any common order.
NEAR_DUPLICATES = f"""
WITH RECURSIVE split AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORD}+') AS ws FROM documents
), shingles AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS s FROM split
), ranked AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY f, s) AS s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS f FROM shingles)
), sized AS MATERIALIZED (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS place FROM ranked
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), rare AS MATERIALIZED (
  SELECT doc_id, s, n FROM sized WHERE place <= n - (80 * n + 99) // 100 + 1
), candidates AS MATERIALIZED (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m
  FROM rare x JOIN rare y ON x.s = y.s AND x.doc_id < y.doc_id AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n
), links AS MATERIALIZED (
  SELECT a, b FROM candidates JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b AND y.s = x.s
  GROUP BY a, b, candidates.n, m HAVING 100 * count(*) >= 80 * (candidates.n + m - count(*))
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
  SELECT a, b FROM edges UNION SELECT reached.doc_id, edges.b FROM reached JOIN edges ON edges.a = reached.other
), smallest AS (
  SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id <= coalesce(other, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0"
_WHOLE = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)"


def _clusters(k: int = 8, rounds: int = 10) -> str:
    """Every round restated: distances over the components as rows, the nearest centroid, floors of means."""
    at = lambda i: f"""a{i} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, m.c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM parts v JOIN m{i} m ON m.i = v.i GROUP BY v.r, m.c) GROUP BY r
)"""  # noqa: E731
    move = lambda i: f"""m{i + 1} AS MATERIALIZED (
  SELECT m.c, m.i, coalesce(x.x, m.x) AS x FROM m{i} m LEFT JOIN (
    SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{i} JOIN parts USING (r) GROUP BY c, i
  ) x ON x.c = m.c AND x.i = m.i
)"""  # noqa: E731
    steps = ", ".join(f"{at(i)}, {move(i)}" for i in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, {_WHOLE} AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = 64
), parts AS MATERIALIZED (
  SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept
), m0 AS MATERIALIZED (
  SELECT c, i, x FROM (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}) JOIN parts USING (r)
), {steps}, {at(rounds)}, means AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c
)
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN means USING (c)
"""


TOP_K = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE {_FINITE}
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(x.v)) + 1), lambda i: q.v[i] * x.v[i])), 0)::BIGINT AS score
  FROM kept q JOIN kept x ON x.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored QUALIFY rank <= 10
"""

#: CRC-32 of the digits, bit by bit: DuckDB has no function for it.
_BITS = "list_reduce(list_concat([x], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
_CRC = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: {_BITS.replace('[x]', '[xor(c, d)]')}), 4294967295)"
TRIE = f"""
WITH turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, ':', text))) - 1 AS place, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), whole AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 100 AS donor, ({_CRC}) % 6 AS h, list({{'role': role, 'text': text}} ORDER BY place) AS own FROM turns GROUP BY conv_id
), rebuilt AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(d.own[1 : c.h], []), c.own[c.h + 1 : ]) AS turns FROM whole c LEFT JOIN whole d ON d.conv_id = c.donor
), entries AS MATERIALIZED (
  SELECT conv_id, d AS depth, turns[1 : d] AS prefix, d = len(turns) AS is_last FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS MATERIALIZED (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_last), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN (count(*) - 1) * length(prefix[depth].text) ELSE 0 END AS saved
  FROM entries GROUP BY prefix, depth
), children AS MATERIALIZED (
  SELECT p.prefix, p.depth, count(*) AS n FROM nodes p JOIN nodes c ON c.depth = p.depth + 1 AND c.prefix[1 : p.depth] = p.prefix GROUP BY p.prefix, p.depth
), below AS MATERIALIZED (
  SELECT up AS depth, prefix[1 : up] AS prefix, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (NOT has) AS n_leaves
  FROM (SELECT n.prefix, n.saved, c.n IS NOT NULL AS has, unnest(range(n.depth + 1)) AS up FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix) GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.prefix = n.prefix LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : n.depth - 1]
"""

ORACLES = {"op3_warc": WARC, "op7_near_duplicates": NEAR_DUPLICATES, "op9_quality_rules": QUALITY_RULES, "op11_conversation_trie": TRIE, "op12_clusters": _clusters(), "op13_top_k": TOP_K}
