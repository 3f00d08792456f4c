"""SQL for DuckDB that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from .license_scan import BLOCK, NOTICES, PHRASES, THRESHOLD, longer_names, name_pattern

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(nodes: str, links: str) -> str:
    """comp(node, comp): the least node reachable over links(a, b), both ways."""
    return f"""reach AS (SELECT n AS node, n AS comp FROM {nodes} UNION SELECT l.b, r.comp FROM reach r JOIN (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}) l ON l.a = r.node WHERE r.comp < l.b),
  comp AS (SELECT node, min(comp) AS comp FROM reach GROUP BY 1)"""


def _licenses() -> str:
    base = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES.items())
    notices = ", ".join(f"({i}, '{label}', '{text}', '{name_pattern(text, names)}', '{'|'.join(longer_names(names)) or '(?:^$)'}')" for i, (label, text, names) in enumerate(NOTICES))
    split = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {split.format(LOWER)} AS w FROM documents),
  phrases(label, p) AS (VALUES {base}), notices(t, label, body, name, longer) AS (VALUES {notices}),
  terms AS (SELECT t, label, name, longer, list_distinct({split.format('body')}) AS need FROM notices),
  starts AS (SELECT k, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS pos FROM d, phrases),
  base AS (SELECT k, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM starts GROUP BY 1),
  blocks AS (SELECT k, w[first + 1 : first + {BLOCK}] AS b FROM (SELECT k, w, unnest(range(0, len(w), {BLOCK // 2})) AS first FROM d)),
  met AS (SELECT k, label, len(list_filter(need, lambda x: list_contains(b, x))) / len(need) AS c, regexp_matches(array_to_string(b, ' '), name) AND NOT regexp_matches(array_to_string(b, ' '), longer) AS named
    FROM blocks, terms WHERE len(list_filter(need, lambda x: list_contains(b, x))) >= ceil({THRESHOLD} * len(need))),
  held AS (SELECT k, label, c FROM met WHERE named), others AS (SELECT k, array_to_string(list_sort(list(DISTINCT label)), ',') AS unnamed FROM met WHERE NOT named GROUP BY 1),
  best AS (SELECT k, max(c) AS c FROM held GROUP BY 1),
  marks AS (SELECT k, label, true AS own FROM starts UNION ALL SELECT k, label, false FROM held),
  lists AS (SELECT k, array_to_string(list_sort(list(DISTINCT label) FILTER (own)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM marks GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(unnamed, '') AS unnamed, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
  FROM d LEFT JOIN base USING (k) LEFT JOIN lists USING (k) LEFT JOIN best USING (k) LEFT JOIN others USING (k)"""


NEAR_DUPLICATES = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d),
  sets AS (SELECT min(doc_id) AS n, len(s) AS size, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY 2, 3),
  parts AS (SELECT n, size, unnest(s) AS x FROM sets),
  links AS (SELECT p.n AS a, q.n AS b FROM parts p JOIN parts q ON p.x = q.x AND p.n < q.n AND 100 * least(p.size, q.size) >= 75 * greatest(p.size, q.size) GROUP BY p.n, q.n, p.size, q.size HAVING 100 * count(*) >= 75 * (p.size + q.size - count(*))),
  {_components('sets', 'links')}
  SELECT doc_id, len(s.s) AS n_shingles, coalesce(comp, doc_id) AS component_id, doc_id = coalesce(comp, doc_id) AS kept FROM s LEFT JOIN sets ON sets.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN comp ON node = n"""

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS n, embedding::DOUBLE[] AS v, label FROM embeddings),
  good AS (SELECT n, label, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS u FROM v WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
  links AS (SELECT p.n AS a, q.n AS b FROM good p JOIN good q ON p.label = q.label AND p.n < q.n AND len(p.u) = len(q.u) WHERE list_dot_product(p.u, q.u) >= 0.93),
  degree AS (SELECT n, count(*) AS k FROM (SELECT a AS n FROM links UNION ALL SELECT b FROM links) GROUP BY 1),
  {_components('v', 'links')}
  SELECT v.n AS vec_id, coalesce(k, 0) AS n_links, comp AS component_id, v.n = comp AS kept FROM v JOIN comp ON node = v.n LEFT JOIN degree USING (n)"""

# The crc32 of a text: DuckDB has none, so its table and bytes are lists.
CRC32 = r"""bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
  bytes AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
  keyed AS (SELECT doc_id, coalesce('=' || source, 'null') AS s, size, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc FROM bytes, bits)"""
FRACTION = "(('0x' || substr({}, 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0"
SHARDS = f"""WITH {CRC32},
  copies AS (SELECT *, row_number() OVER (PARTITION BY s, doc_id, size, crc) - 1 AS i FROM keyed),
  hashed AS (SELECT *, md5('42|' || s || '|' || coalesce(doc_id::VARCHAR, '') || '|' || size || '|' || crc || '|' || i) AS h FROM copies),
  ranked AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h) - 1 + {FRACTION.format("md5('42|' || s)")}) / count(*) OVER (PARTITION BY s) AS f FROM hashed),
  placed AS (SELECT *, row_number() OVER (ORDER BY f, h) - 1 AS p, count(*) OVER () AS n FROM ranked)
  SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (p * 40 // n)::INT AS shard, p - ((p * 40 // n) * n + 39) // 40 AS slot, NULL::INT AS grown_shard FROM placed"""

BLANK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
MIXTURE = f"""WITH d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, len({BLANK_WORDS})::BIGINT AS size, md5(coalesce(text, '')) AS m FROM documents),
  copies AS (SELECT *, row_number() OVER (PARTITION BY s, doc_id, size, m) - 1 AS i FROM d),
  hashed AS (SELECT *, md5('42|' || s || '|' || coalesce(doc_id::VARCHAR, '') || '|' || size || '|' || m || '|' || i) AS h FROM copies),
  before AS (SELECT *, sum(size) OVER (PARTITION BY s ORDER BY h) - size AS b, sum(size) OVER (PARTITION BY s) AS source_size FROM hashed),
  sources AS (SELECT s, sum(size)::BIGINT AS n, ((row_number() OVER (ORDER BY s = 'null', s) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY s),
  limits AS (SELECT *, coalesce(sum(3 * n) OVER o, 0) AS n_before, coalesce(sum(w) OVER o, 0) AS w_before FROM sources WINDOW o AS (ORDER BY 3 * n / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  level AS (SELECT max(((SELECT sum(n) FROM sources)::DOUBLE - n_before::DOUBLE) / ((SELECT sum(w) FROM sources) - w_before)) AS level FROM limits),
  targets AS (SELECT s, n, least((3 * n)::DOUBLE, w * level) AS target FROM sources, level),
  cuts AS (SELECT *, floor(target + 0.5)::BIGINT // greatest(n, 1) AS whole, floor(target + 0.5)::BIGINT % greatest(n, 1) AS rest FROM targets)
  SELECT doc_id, size, source_size::BIGINT AS source_size, target, (whole * size + greatest(0, least(size, rest - b)))::BIGINT AS taken FROM before JOIN cuts USING (s)"""

# All pairs of equal words at distances of up to a fourth of the text; stretches of them are runs.
RUNS = rf"""WITH bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
  d AS (SELECT row_number() OVER () AS k, doc_id, {BLANK_WORDS} AS w, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
  hashed AS (SELECT k, doc_id, w, len(w) AS n, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM d, bits),
  cut AS (SELECT *, (h // 10) % nullif(n, 0) AS a, 1 + (n - (h // 10) % nullif(n, 0)) // (3 + (h // 10) % 8) AS p FROM hashed),
  texts AS (SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1] FOR i IN range(n)] ELSE w END AS w FROM cut),
  words AS (SELECT k, n, unnest(w) AS x, unnest(range(n)) AS i FROM texts),
  equal AS (SELECT a.k, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.k = b.k AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
  stretches AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g FROM equal) GROUP BY k, q, g),
  runs AS (SELECT k, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY k, start, length),
  best AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first({{'start': start, 'length': length, 'period': period}} ORDER BY length::DOUBLE / period DESC, start, period) AS r FROM runs GROUP BY k),
  dropped AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
  kept AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS body FROM words ANTI JOIN dropped USING (k, i) GROUP BY k)
  SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.start AS start, r.length AS length, r.period AS period, 1000 * r.length // r.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
  FROM texts LEFT JOIN best USING (k) LEFT JOIN kept USING (k)"""

SEARCH_TERMS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {SEARCH_TERMS} AS w FROM documents),
  tokens AS (SELECT k, unnest(w) AS t FROM d), tf AS (SELECT k, t, count(*) AS tf FROM tokens GROUP BY 1, 2),
  df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
  total AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
  lengths AS (SELECT k, doc_id, 10 + (90 * len(w) * n) // l AS m FROM d, total WHERE len(w) > 0),
  asked AS (SELECT row_number() OVER () AS q, item_id, w FROM (SELECT DISTINCT item_id, list_sort(list_distinct({SEARCH_TERMS})) AS w FROM benchmark)),
  weights AS (SELECT q, item_id, t, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT q, item_id, unnest(w) AS t FROM asked) JOIN df USING (t), total),
  scores AS (SELECT q, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM weights JOIN tf USING (t) JOIN lengths USING (k) GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
  SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

ORACLES = {"op11_mixing": MIXTURE, "op12_periodic_runs": RUNS, "op13_lexical_search": SEARCH, "op7_sharding": SHARDS, "op1_license_scan": _licenses(), "op5_near_dedup": NEAR_DUPLICATES, "op9_embedding_dedup": NEAR_VECTORS}
