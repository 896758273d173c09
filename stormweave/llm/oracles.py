"""Reference SQL (DuckDB) of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from stormweave.llm.centroids import CLUSTERS, COMPONENTS, ROUNDS, SCALE
from stormweave.llm.quality import STOP_WORDS
from stormweave.llm.secrets import BASE, KINDS, LONG_VALUE, NAMED, PATTERNS, REACH

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))

QUALITY = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
window3 AS (
  SELECT * FROM (
    SELECT doc_id, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o] AS three, lead(w, 2) OVER o IS NOT NULL AS whole
    FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE whole
),
twin AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM window3) WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twin) GROUP BY doc_id
),
counted AS (
  SELECT s.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda w: w IN ({_STOP}))) AS n_stop,
         len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•‣]'))) AS n_bullet,
         len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.1
         AND n_stop / n_words >= 0.02
         AND (n_lines = 0 OR (n_dup_lines / n_lines <= 0.5 AND n_bullet / n_lines <= 0.9 AND n_ellipsis / n_lines <= 0.3)) AS kept
FROM judged
"""


def _rounds() -> str:
    """Rounds of assignment over every pair of a vector and a centroid, unrolled."""
    blocks = []
    for k in range(ROUNDS + 1):
        blocks.append(f"""
a{k} AS MATERIALIZED (
  SELECT rowno, vec_id, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), no := no)) AS best
  FROM kept, c{k} GROUP BY rowno, vec_id, x
)""")
        if k < ROUNDS:
            blocks.append(f"""
s{k} AS (
  SELECT no, i, sum(v)::BIGINT AS s, count(*) AS n
  FROM (SELECT best.no AS no, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY no, i
),
c{k + 1} AS MATERIALIZED (
  SELECT c.no, coalesce(m.c, c.c) AS c
  FROM c{k} c LEFT JOIN (SELECT no, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY no) m ON m.no = c.no
)""")
    return ",".join(blocks)


CENTROIDS = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rowno, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {COMPONENTS}
),
c0 AS MATERIALIZED (
  SELECT no, x AS c FROM (
    SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS no FROM kept
  ) WHERE no < {CLUSTERS}
),{_rounds()}
SELECT vec_id, CAST(best.no AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.no) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{ROUNDS}.c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.no = best.no
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: str) -> str:
    pattern = _quoted(PATTERNS[kind])
    return f"""
SELECT rowno, text, '{kind}' AS kind, piece, w, v, sum(length(piece) + length(w)) OVER (PARTITION BY rowno ORDER BY i) AS stop
FROM (
  SELECT rowno, text, unnest(matches) AS w, unnest(vals) AS v, unnest(pieces[1:len(matches)]) AS piece, generate_subscripts(matches, 1) AS i
  FROM (
    SELECT rowno, text, regexp_extract_all(text, {pattern}) AS matches, regexp_extract_all(text, {pattern}, 1) AS vals,
           regexp_split_to_array(text, {pattern}) AS pieces FROM docs
  )
)"""


_SCAN = " UNION ALL ".join(_matches(k) for k in KINDS)
_BLANK = r"\n[\x20\t\r]*\n.*$"

SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS rowno, doc_id, coalesce(text, '') AS text FROM documents),
scan AS ({_SCAN}),
good AS (
  SELECT rowno, text, kind, CAST(stop - length(w) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
         CASE WHEN kind IN ('access', 'identifier') THEN 'identifier' WHEN kind = 'endpoint' THEN 'endpoint'
              WHEN kind = 'hex' AND NOT regexp_matches(w, '[a-f]') THEN 'none' ELSE 'secret' END AS role
  FROM scan
  WHERE CASE kind
    WHEN 'assign' THEN length(v) >= 12
    WHEN 'access' THEN length(w) >= 18
    WHEN 'hex' THEN true
    WHEN 'phrase' THEN NOT regexp_matches(piece, '[A-Za-z0-9]$') AND NOT regexp_matches(w, {_quoted("^" + LONG_VALUE)})
    WHEN 'opaque' THEN regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]')
                       AND NOT regexp_matches(piece, {_quoted(NAMED + "$")})
    ELSE NOT regexp_matches(piece, '[A-Za-z0-9_]$') END
),
roomy AS (
  SELECT *, least({REACH}, length(regexp_replace(substr(text, stop + 1), {_quoted(_BLANK)}, '', 's'))) AS room
  FROM good
),
pairs AS (
  SELECT a.rowno, a.kind AS k1, a.start AS s1, a.stop AS e1, b.kind AS k2, b.start AS s2, b.stop AS e2
  FROM roomy a JOIN roomy b ON a.rowno = b.rowno AND b.start - a.stop BETWEEN 0 AND a.room
  WHERE a.role <> 'none' AND b.role <> 'none' AND (a.role = 'secret') <> (b.role = 'secret')
),
reported AS (
  SELECT rowno, kind, start, stop FROM good WHERE kind IN {BASE}
  UNION ALL
  SELECT DISTINCT * FROM (SELECT rowno, k1 AS kind, s1 AS start, e1 AS stop FROM pairs UNION ALL SELECT rowno, k2, s2, e2 FROM pairs) WHERE kind NOT IN {BASE}
),
listed AS (
  SELECT rowno, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, list_position({list(KINDS)}, kind), stop) AS spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, list_position({list(KINDS)}, kind), stop) FILTER (kind IN {BASE}) AS base,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
  FROM reported GROUP BY rowno
),
linked AS (SELECT rowno, count(*) AS n_links FROM pairs GROUP BY rowno)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_links, 0)::BIGINT AS n_links
FROM docs d LEFT JOIN listed l ON l.rowno = d.rowno LEFT JOIN linked k ON k.rowno = d.rowno
"""
