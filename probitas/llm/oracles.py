"""DuckDB SQL for the queries whose whole result SQL can express, written apart from the operators."""

from __future__ import annotations

_ALPHABETS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# Every pair of one label, then the smallest id reachable over links.
VECTOR_GRAPH = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(l.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(l.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id"""


def _strength(level: str) -> str:
    """Strength of a level's prior by analysis of variance, 1 to 10,000 pseudo-pages."""
    return f"""(SELECT CASE WHEN k < 2 OR s0 <= k THEN 1.0 WHEN spread <= 0 OR between_ <= within_ THEN 10000.0
      ELSE least(10000.0, greatest(1.0, (1 - (between_ - within_) / spread) / ((between_ - within_) / spread))) END
   FROM (SELECT *, between_ + (size - 1) * within_ AS spread FROM (
     SELECT k, s0, (s2 - s1 * s1 / s0) / nullif(k - 1, 0) AS between_, (s1 - s2) / nullif(s0 - k, 0) AS within_,
            (s0 - nn / s0) / nullif(k - 1, 0) AS size
     FROM (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS s0, CAST(sum(x) AS DOUBLE) AS s1, sum(x * x / CAST(n AS DOUBLE)) AS s2,
                  CAST(sum(n * n) AS DOUBLE) AS nn FROM {level} WHERE n > 0))))"""


# Fixed rules of the query, longest first.
URL_REPUTATION = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_ALPHABETS}) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts),
labelled AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 0 WHEN rule IS NOT NULL THEN 1 END AS bad,
         string_split(host, '.') AS labels FROM ruled),
levels AS (
  SELECT *, array_to_string(labels[-2:], '.') AS two FROM labelled),
named AS (
  SELECT *, two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'com.br', 'co.jp') AS long FROM levels),
hosts AS (
  SELECT host, CASE WHEN long THEN array_to_string(labels[-3:], '.') ELSE two END AS domain,
         CASE WHEN long THEN two ELSE labels[-1] END AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS x
  FROM named GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL),
strengths AS (SELECT {_strength('hosts')} AS kh, {_strength('domains')} AS kd, {_strength('suffixes')} AS ks,
                     (SELECT CAST(sum(n) AS DOUBLE) + 2.0 FROM hosts) AS known, (SELECT sum(x) + 1.0 FROM hosts) AS bad),
s AS (SELECT suffix, (x + bad / known * k) / (n + k) AS m, n + k AS known
      FROM (SELECT suffixes.*, t.bad, t.known, t.ks * t.known / (t.ks + t.known) AS k FROM suffixes, strengths t)),
d AS (SELECT domain, (x + m * k) / (n + k) AS m, n + k AS known
      FROM (SELECT domains.*, s.m, t.kd * s.known / (t.kd + s.known) AS k FROM domains JOIN s USING (suffix), strengths t)),
h AS (SELECT host, x + m * k AS a, n - x + (1 - m) * k AS b
      FROM (SELECT hosts.*, d.m, t.kh * d.known / (t.kh + d.known) AS k FROM hosts JOIN d USING (domain), strengths t))
SELECT page_id, host, path, rule,
       CASE WHEN bad = 1 THEN 'block' WHEN bad = 0 THEN 'allow'
            WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM labelled JOIN h USING (host)"""

HARD_NEGATIVES = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS alike, r.vec_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM q a JOIN q r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank",
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def _value(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE concat(strlen(CAST({column} AS VARCHAR)), ':', {column}) END"


def _table_step(depth: int) -> str:
    """The 256 entries of crc32's table: eight steps of the reversed polynomial on 0 to 255."""
    inner = "range(256)" if depth == 0 else _table_step(depth - 1)
    return inner if depth == 0 else f"list_transform({inner}, lambda c: xor(c >> 1, 3988292384 * (c & 1)))"


_LEAF = f"sha256(concat({_value('doc_id')}, {_value('source')}, {_value('lang')}, {{n_chars}}, {_value('text')}))"

MERKLE_MANIFEST = f"""
WITH RECURSIVE crc AS (SELECT {_table_step(8)} AS entries
), d AS (
  SELECT doc_id, lang, {_LEAF.format(n_chars=_value('n_chars'))} AS leaf, {_LEAF.format(n_chars=_value('(n_chars + 1)'))} AS raised,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1),
             lambda k: CAST(ord(CAST(doc_id AS VARCHAR)[k]) AS BIGINT))),
             lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) % 7 = 0 AS tampered
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)
), nodes(lang, level, pos, n, digest) AS (
  SELECT lang, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subs AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes(level, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subs
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 2, n
), top AS (SELECT digest AS root FROM upper_nodes WHERE n = 1
), steps AS (
  SELECT p.lang, p.pos, l.level, coalesce(CASE WHEN (p.pos >> l.level) & 1 = 1 THEN 'l' ELSE 'r' END || s.digest, '-') AS step
  FROM placed p JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = l.level AND s.pos = xor(p.pos >> l.level, 1)
  UNION ALL
  SELECT p.lang, p.pos, 1000 + l.level, coalesce(CASE WHEN (u.pos >> l.level) & 1 = 1 THEN 'l' ELSE 'r' END || s.digest, '-')
  FROM placed p JOIN subs u ON u.lang IS NOT DISTINCT FROM p.lang
  JOIN (SELECT DISTINCT level FROM upper_nodes WHERE n > 1) l ON true
  LEFT JOIN upper_nodes s ON s.level = l.level AND s.pos = xor(u.pos >> l.level, 1)
), paths AS (SELECT lang, pos, list(step ORDER BY level) AS path FROM steps GROUP BY lang, pos
), folded AS (
  SELECT p.*, coalesce(path, []) AS path,
         list_reduce(list_prepend(CASE WHEN tampered AND raised IS NOT NULL THEN raised ELSE leaf END, coalesce(path, [])),
           lambda a, s: CASE WHEN s[1] = 'l' THEN sha256(s[2:] || a) WHEN s[1] = 'r' THEN sha256(a || s[2:]) ELSE sha256(a) END) AS folded_root
  FROM placed p LEFT JOIN paths t ON t.lang IS NOT DISTINCT FROM p.lang AND t.pos = p.pos
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(path, lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded f JOIN subs u ON u.lang IS NOT DISTINCT FROM f.lang, top
"""

# crc32 of the whole text over its bytes; rows in order of id, checksum and size, cut where the middle of a row's bytes falls.
BYTE_SHARDS = f"""
WITH crc AS (SELECT {_table_step(8)} AS entries
), d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
             lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, crc
), placed AS (
  SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total FROM d
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), cut AS (
  SELECT *, CAST(least(23, (2 * upto - size) * 24 // (2 * total)) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""
