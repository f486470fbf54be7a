"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

OP7 = rf"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', doc_id, text)), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source
), r AS (  -- by fullness: a source is full if its cap is under level * weight
  SELECT *, 2 * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(2 * source_size) OVER before, 0) AS capped,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w
  FROM s
  WINDOW before AS (ORDER BY 2 * source_size / w::DOUBLE ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min((budget - capped) / open_w, cap / w) AS level FROM r WHERE (budget - capped) / open_w * w <= cap
), t AS (
  SELECT source, source_size,
         CASE WHEN cap < level * w THEN cap ELSE level * w END::DOUBLE AS target
  FROM r, l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times FROM t
), g AS (
  SELECT source, h, sum(size) AS here, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
  FROM d GROUP BY source, h
), edge AS (
  SELECT e.source, arg_min(g.h, g.h) AS edge, arg_min(g.upto - g.here, g.h) AS below, arg_min(g.here, g.h) AS here
  FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source
  WHERE g.upto > e.target - e.times * e.source_size
  GROUP BY e.source
)
SELECT d.doc_id, d.size, e.source_size, e.target,
       d.size * (e.times + CASE WHEN d.h < x.edge
           OR d.h = x.edge AND x.below + x.here / 2.0 < e.target - e.times * e.source_size
         THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
LEFT JOIN edge x ON d.source IS NOT DISTINCT FROM x.source
"""


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: pieces between the matches and the matches alternate."""
    return rf"""
SELECT doc_id, row, '{kind}' AS kind, pos + len(gap) AS start, pos + len(gap) + len(hit) AS "end" FROM (
  SELECT doc_id, row, gaps[i] AS gap, hits[i] AS hit, parts[i] AS part,
         coalesce(list_sum([len(x) FOR x IN gaps[:i - 1]]), 0)
         + coalesce(list_sum([len(x) FOR x IN hits[:i - 1]]), 0) AS pos
  FROM (
    SELECT doc_id, row, regexp_split_to_array(text, $re${pattern}$re$) AS gaps,
           regexp_extract_all(text, $re${pattern}$re$, 0) AS hits,
           regexp_extract_all(text, $re${pattern}$re$, {group}) AS parts
    FROM t
  ), unnest(range(1, len(hits) + 1)) AS u(i)
) WHERE len(part) >= {least}
"""


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PLAIN_KINDS = [
    ("access", r"AKIA[A-Z0-9]{14,}"),
    ("hex", r"[0-9a-f]{16,}"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google", r"AIza[0-9A-Za-z_-]{35}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]
KINDS = ["assign", *[kind for kind, _ in PLAIN_KINDS]]

OP10 = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
found AS (
{_spans("assign", ASSIGN, 2, 12)}
{"".join("UNION ALL" + _spans(kind, pattern, 0, 0) for kind, pattern in PLAIN_KINDS)}
), placed AS (
  SELECT *, list_position({KINDS}, kind) AS place, kind || ':' || start || ':' || "end" AS said FROM found
), joined AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(said, ',' ORDER BY start, place) FILTER (place <= 3) AS base,
         string_agg(said, ',' ORDER BY start, place) AS spans
  FROM placed GROUP BY row
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN joined USING (row)
"""

TOKENS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {TOKENS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {TOKENS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)
), hit AS (SELECT * FROM dw WHERE win IN (SELECT win FROM bw)),
covered AS (SELECT row, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS u(j) GROUP BY row),
items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item FROM hit JOIN bw USING (win)) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN items USING (row)
"""

#: Base32 of a SHA-1: five hex digits are twenty bits, four digits of base 32.
OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS hex
  FROM pages
), q AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY payload) AS first,
         array_to_string([
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
             1 + ((('0x' || hex[5 * (i // 4) + 1:5 * (i // 4) + 5])::BIGINT >> (5 * (3 - i % 4))) & 31)]
           FOR i IN range(0, 32)], '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (SELECT lang, source, row, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
gs AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM gs JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n,
         (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v))::BIGINT AS p
  FROM dense JOIN v USING (lang)
), q AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v))::BIGINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts
) WHERE part = 'pair' OR rank <= 10
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), w AS (  -- what would not be read back as it is gets one more backslash between each < and |
  SELECT *,
    CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')
         THEN regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') ELSE text END AS body,
    CASE WHEN contains(role, '<|im_start|>') OR contains(role, '<|im_end|>') OR contains(role, '<|nl|>')
           OR contains(role, chr(10)) OR regexp_matches(role, '<\\+\|')
         THEN replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>') ELSE role END AS name
  FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(name) + length(body) + length('<|im_start|>') + length('<|im_end|>') + 2)::BIGINT AS formatted_chars
  FROM w GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM c
"""

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach(v, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.v
), least AS (SELECT v, min(c) AS c FROM reach GROUP BY v),
degree AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN least ON v = vec_id LEFT JOIN degree ON a = vec_id
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         coalesce(list_sum([a.c[i] * b.c[i] FOR i IN range(1, len(a.c) + 1)]), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.c) = len(b.c)
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLE = {"op5_format_chats": OP5, "op8_embedding_groups": OP8, "op12_hard_negatives": OP12, "op13_source_divergence": OP13, "op4_warc": OP4, "op2_decontaminate": OP2, "op7_mix_sources": OP7, "op10_secret_scan": OP10}
