"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from terralag.llm.secret_scan import BASE, BLANK, FINDERS, KINDS, LEAST, REACH

#: The table of CRC-32 by its rule, and the checksum of a text's bytes given as hex digits.
CRC_TABLE = """crc_steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""


def crc32(x: str) -> str:
    return f"""xor(list_reduce(list_transform(range(len({x}) // 2), lambda i: ('0x' || substr({x}, 2 * i + 1, 2))::BIGINT),
                lambda c, b: xor(c // 256, tab[1 + xor(c, b) % 256]), 4294967295::BIGINT), 4294967295)"""


OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, texts AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL
  SELECT 'b', 0, -1, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS MATERIALIZED (
  SELECT side, doc_id, r, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), counted AS MATERIALIZED (
  SELECT side, r, f, count(*) AS n FROM runs GROUP BY side, r, f
), kinds AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)
), hashed AS MATERIALIZED (
  SELECT f, {crc32('x')} % 10000 AS bucket
  FROM kinds, crc_table
), found AS MATERIALIZED (SELECT side, r, bucket, n FROM counted JOIN hashed USING (f)
), gains AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1) * (all_t + 10000.0::DOUBLE)))) AS gain
  FROM range(10000) k(b)
  LEFT JOIN (SELECT bucket, sum(n)::DOUBLE AS s FROM found WHERE side = 'd' GROUP BY bucket) x ON x.bucket = b
  LEFT JOIN (SELECT bucket, sum(n)::DOUBLE AS t FROM found WHERE side = 'b' GROUP BY bucket) y ON y.bucket = b,
  (SELECT coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS all_s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS all_t FROM found)
), weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT d.doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words d LEFT JOIN weights USING (r) WHERE side = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""


def _candidates() -> str:
    """Every match that is long enough, with its place; pieces between the matches give the places."""
    parts = []
    for n, kind in enumerate(KINDS, 1):
        pattern = FINDERS[kind].replace("'", "''")
        group = f"regexp_extract(m, '{pattern}', 2)" if kind in ("assign", "account", "phrase") else "m"
        mixed = " AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')" if kind == "bare" else ""
        parts.append(f"""
  SELECT r, text, {n} AS k, '{kind}' AS kind, a, a + length(m) AS b FROM (
    SELECT r, text, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)))::BIGINT AS a, unnest(ms) AS m
    FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM texts) x WHERE len(ms) > 0
  ) y WHERE length({group}) >= {LEAST[kind]}{mixed}""")
    return " UNION ALL ".join(parts)


_OVERLAP = "x.r = y.r AND x.a < y.b AND y.a < x.b"
_BESIDE = f"x.r = y.r AND x.scope = y.scope AND greatest(y.a - x.b, x.a - y.b) <= {REACH}"
_IDENTIFIER, _SECRET = "y.kind IN ('access', 'account')", "y.kind IN ('assign', 'hex', 'phrase', 'bare')"
_BASE = ", ".join(f"'{k}'" for k in BASE)

OP12_SQL = f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), found AS MATERIALIZED ({_candidates()}
), apart AS MATERIALIZED (
  SELECT * FROM found x WHERE kind IN ({_BASE}) OR NOT EXISTS (SELECT 1 FROM found y WHERE {_OVERLAP} AND y.kind IN ({_BASE}))
), parts AS MATERIALIZED (
  SELECT *, len(regexp_extract_all(substr(text, 1, a), '{BLANK}')) AS scope FROM apart x
  WHERE kind <> 'bare' OR NOT EXISTS (SELECT 1 FROM apart y WHERE {_OVERLAP} AND y.kind IN ('account', 'phrase', 'endpoint'))
), linked AS MATERIALIZED (
  SELECT *, EXISTS (SELECT 1 FROM parts y WHERE {_BESIDE} AND {_IDENTIFIER}) AS by_identifier,
         EXISTS (SELECT 1 FROM parts y WHERE {_BESIDE} AND {_SECRET}) AS by_secret FROM parts x
), spans AS (
  SELECT r, kind, k, a, b, kind IN ('access', 'account') AND by_secret AS credential, kind || ':' || a || ':' || b AS span FROM linked
  WHERE kind IN ({_BASE}) OR CASE kind WHEN 'account' THEN by_secret WHEN 'endpoint' THEN by_identifier AND by_secret ELSE by_identifier END
), folded AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY a, k) FILTER (kind IN ({_BASE})) AS base, string_agg(span, ',' ORDER BY a, k) AS spans,
         count(*) FILTER (credential) AS n_credentials FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_credentials, 0) AS n_credentials FROM texts LEFT JOIN folded USING (r)
"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


_LEAF = "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars"))) + " || {})"
_TAMPERED = _field("(CASE WHEN " + crc32("x") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")

OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, numbered AS MATERIALIZED (
  SELECT d.*, {_LEAF.format(_field("text"))} AS leaf, {_LEAF.format(_TAMPERED)} AS other, row_number() OVER () AS r
  FROM (SELECT *, hex(encode(doc_id::VARCHAR)) AS x FROM documents) d, crc_table
), sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)
), nodes(level, tree, i, n, h) AS (
  SELECT 0, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1, count(*) OVER (PARTITION BY tree), leaf
  FROM numbered d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT level + 1, tree, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, tree, i // 3, n
), subroots AS (SELECT tree, level, h FROM nodes WHERE n = 1
), upper_nodes(level, i, n, h) AS (
  SELECT 0, tree, count(*) OVER (), h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM upper_nodes WHERE n > 1 GROUP BY level, i // 3, n
), step AS MATERIALIZED (
  SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.i
), upper_step AS MATERIALIZED (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM upper_nodes a JOIN upper_nodes b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.level, a.i
), placed AS (
  SELECT d.doc_id, d.leaf, d.other, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, d.r
  FROM numbered d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
), walk(r, level, tree, i, over, proof, folded) AS (
  SELECT r, 0, tree, i, false, '', other FROM placed
  UNION ALL
  SELECT w.r, CASE WHEN w.over OR s.tree IS NOT NULL THEN w.level + 1 ELSE 0 END, w.tree, CASE WHEN w.over OR s.tree IS NOT NULL THEN w.i // 3 ELSE w.tree END,
         w.over OR s.tree IS NULL, proof || CASE WHEN w.over THEN u.before || u.after ELSE coalesce(s.before || s.after, '') END,
         CASE WHEN w.over THEN sha256(u.before || folded || u.after) WHEN s.tree IS NOT NULL THEN sha256(s.before || folded || s.after) ELSE folded END
  FROM walk w LEFT JOIN step s ON NOT w.over AND s.tree = w.tree AND s.level = w.level AND s.i = w.i
  LEFT JOIN upper_step u ON w.over AND u.level = w.level AND u.i = w.i WHERE NOT w.over OR u.level IS NOT NULL
), ends AS (SELECT r, max_by(proof, level) AS proof, max_by(folded, level) AS folded FROM walk WHERE over GROUP BY r)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN subroots s USING (tree) JOIN ends USING (r), (SELECT h AS root FROM upper_nodes WHERE n = 1)
"""
