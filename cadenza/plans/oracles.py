"""The same queries as SQL for DuckDB, written independently of the DataFrame plans."""

from __future__ import annotations

# Common table expressions that several queries start from.
LIKES = "likes AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS song_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
UI = "ui AS (SELECT o_custkey AS user_id, l_partkey AS song_id, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
PLAYS = """plays AS (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, song_id) AS seq
  FROM (SELECT o_custkey AS user_id, l_partkey AS song_id, max(o_orderdate) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2))"""
CATALOG = """cat AS (SELECT p_partkey AS song_id, p_name AS title, string_split(p_name, ' ') AS tags, lower(p_type) AS genre, p_brand AS creator, p_size::DOUBLE AS duration,
  coalesce(plays, 0) AS play_count, coalesce(ups, 0) AS upvote_count, coalesce(coms, 0) AS comment_count
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS plays, count(*) FILTER (l_returnflag = 'A') AS ups, count(*) FILTER (l_returnflag = 'R') AS coms FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""
ENGAGED = CATALOG + """, eng AS (SELECT *, round((upvote_count + comment_count) / greatest(play_count, 1), 6) AS engagement_rate, round(ln(1 + play_count) + 2 * ln(1 + upvote_count), 6) AS popularity_score FROM cat)"""
HISTORY = """hist AS (SELECT user_id, (props::JSON->>'$.k')::BIGINT AS song_id, ts, value AS weight, event_type AS type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""
LAST50 = HISTORY + ", l50 AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 50)"
STREAM = """stream AS (SELECT user_id, (props::JSON->>'$.k')::BIGINT AS song_id, ts, event_id, value AS weight, event_type AS type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, (props::JSON->>'$.k')::BIGINT NULLS FIRST, event_id) AS seq FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""
PLAYLISTS = """entries AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'h' || o_custkey ELSE '' END AS handle, CASE WHEN o_orderstatus <> 'F' THEN 'u' || o_custkey ELSE '' END AS uid,
  CASE WHEN o_totalprice < 100000 THEN 'd' || o_custkey ELSE '' END AS display, l_partkey AS song_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
VECTORS = "vec AS (SELECT vec_id AS song_id, embedding::DOUBLE[] AS v, label FROM embeddings), unit AS (SELECT song_id, label, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS v FROM vec)"
MEANS = """mv AS (SELECT user_id, i, avg(x) AS x FROM (SELECT h.user_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 8) h JOIN vec USING (song_id)) GROUP BY 1, 2),
  means AS (SELECT user_id, list(x ORDER BY i) AS m FROM mv GROUP BY 1), umeans AS (SELECT user_id, [x / sqrt(list_dot_product(m, m)) FOR x IN m] AS m FROM means)"""
QUALITY = ENGAGED + """, parts AS (SELECT song_id, engagement_rate AS e, ln(1 + play_count) AS p, upvote_count / (play_count + 1) AS u FROM eng),
  quality AS (SELECT song_id, round(0.4 * (e - min(e) OVER ()) / (max(e) OVER () - min(e) OVER () + 1e-8) + 0.3 * (p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER () + 1e-8)
  + 0.3 * (u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER () + 1e-8), 6) AS quality_score FROM parts)"""


def cosine(source: str, of: str, over: str, weight: str = "1.0") -> str:
    return f"""norms AS (SELECT {of} AS n, sqrt(sum({weight} * {weight})) AS norm FROM {source} GROUP BY 1),
  sims AS (SELECT a, b, round(dot / (x.norm * y.norm), 6) AS sim FROM (SELECT s.{of} AS a, t.{of} AS b, sum(s.{weight} * t.{weight}) AS dot FROM {source} s JOIN {source} t ON s.{over} = t.{over} AND s.{of} <> t.{of} GROUP BY 1, 2) JOIN norms x ON x.n = a JOIN norms y ON y.n = b)"""


ONES = "ones AS (SELECT *, 1.0::DOUBLE AS w FROM likes)"
ITEM_SIMS = f"{LIKES}, {ONES}, {cosine('ones', 'song_id', 'user_id', 'w')}"
USER_SIMS = f"{LIKES}, {ONES}, {cosine('ones', 'user_id', 'song_id', 'w')}"


def first(k: int, by: str, order: str, rank: str = "rank") -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS {rank}"


def top_sims(sims: str, k: int) -> str:
    return f"WITH {sims} SELECT a, b, sim, {first(k, 'a', 'sim DESC, b')} FROM sims QUALIFY rank <= {k}"


def item_cf(n: int) -> str:
    return f"""near AS (SELECT a AS seed, b AS song_id, sim FROM sims WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 5),
  seeds AS (SELECT user_id, song_id FROM plays QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 16),
  scored AS (SELECT s.user_id, n.song_id, round(sum(sim), 6) AS score, count(*) AS seeds, (list(seed ORDER BY sim DESC, seed))[1] AS primary_seed FROM seeds s JOIN near n ON n.seed = s.song_id GROUP BY 1, 2),
  item_cf AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) AS rank FROM scored ANTI JOIN seeds USING (user_id, song_id) QUALIFY rank <= {n})"""


def user_cf(n: int) -> str:
    return f"""unear AS (SELECT a AS user_id, b AS other, sim FROM usims QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 20),
  recent AS (SELECT user_id AS other, song_id, -seq AS place FROM plays QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 50),
  offered AS (SELECT * FROM unear JOIN recent USING (other) ANTI JOIN likes USING (user_id, song_id) QUALIFY row_number() OVER (PARTITION BY user_id, other ORDER BY place, song_id) <= 5),
  pool AS (SELECT user_id, song_id, (list(other ORDER BY sim DESC, other))[1] AS source_user FROM offered GROUP BY 1, 2),
  user_cf AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) AS rank FROM (SELECT p.user_id, p.song_id, source_user, round(sum(sim), 6) AS score
    FROM pool p JOIN unear n ON n.user_id = p.user_id JOIN likes l ON l.user_id = n.other AND l.song_id = p.song_id GROUP BY 1, 2, 3) QUALIFY rank <= {n})"""


USIMS = cosine("ones", "user_id", "song_id", "w").replace("norms", "unorms").replace("sims AS", "usims AS")
TWO = f"{ITEM_SIMS}, {USIMS}, {PLAYS}, {item_cf(30)}, {user_cf(30)}"
BLEND = """chan AS (SELECT user_id, song_id, 'item_cf' AS channel, round(score * 0.25, 8) AS s FROM item_cf UNION ALL SELECT user_id, song_id, 'user_based', round(score * 0.25, 8) FROM user_cf),
  blend AS (SELECT user_id, song_id, round(sum(s), 8) AS recall_score, (list(channel ORDER BY s DESC, channel))[1] AS primary_channel FROM chan GROUP BY 1, 2)"""
RECOMMENDED = """gated AS (SELECT b.*, coalesce(quality_score, 0.3) AS quality_score FROM blend b LEFT JOIN quality USING (song_id) WHERE coalesce(quality_score, 0.3) >= 0.3),
  recommended AS (SELECT user_id, song_id, recall_score, quality_score, recall_score AS fine_score, primary_channel, row_number() OVER (PARTITION BY user_id ORDER BY recall_score DESC, song_id) AS rank FROM gated QUALIFY rank <= 10)"""


def uniform(seed: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


SPLIT_DATE = """firsts AS (SELECT o_custkey AS user_id, l_partkey AS song_id, min(o_orderdate) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  before AS (SELECT * FROM firsts WHERE ts < TIMESTAMP '1997-01-01'), relevant AS (SELECT user_id, song_id FROM firsts WHERE ts >= TIMESTAMP '1997-01-01'),
  nation_of AS (SELECT c_custkey AS user_id, c_nationkey AS nation FROM customer),
  best AS (SELECT nation, song_id, row_number() OVER (PARTITION BY nation ORDER BY n DESC, song_id) AS pos FROM (SELECT nation, song_id, count(*) AS n FROM before JOIN nation_of USING (user_id) GROUP BY 1, 2) QUALIFY pos <= 40),
  lists AS (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rank FROM (SELECT user_id, song_id, pos FROM nation_of JOIN best USING (nation)) ANTI JOIN before USING (user_id, song_id))"""
METRICS = SPLIT_DATE + """, size AS (SELECT user_id, count(DISTINCT song_id) AS size FROM relevant GROUP BY 1),
  hits AS (SELECT user_id, rank, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS hit FROM lists SEMI JOIN relevant USING (user_id, song_id)),
  metrics AS (SELECT user_id, k, round(count(rank) / k, 6) AS precision, round(count(rank) / size, 6) AS recall,
    round(coalesce(sum(1 / log2(rank + 1)), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(size, k) + 1)]), 6) AS ndcg, round(coalesce(avg(hit / rank), 0), 6) AS map
    FROM (SELECT user_id, size, k, rank, hit FROM (SELECT user_id, size, unnest([5, 10, 20]) AS k FROM size) LEFT JOIN hits USING (user_id) WHERE rank IS NULL OR rank <= k
      UNION ALL SELECT user_id, size, k, NULL, NULL FROM (SELECT user_id, size, unnest([5, 10, 20]) AS k FROM size) WHERE user_id IN (SELECT user_id FROM hits)) GROUP BY user_id, k, size)"""
COUNTS = f"{LIKES}, users AS (SELECT user_id, count(*) AS n FROM likes GROUP BY 1), items AS (SELECT p_partkey AS song_id, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT song_id, count(*) AS n FROM likes GROUP BY 1) ON song_id = p_partkey)"
MEMBERS = "coalesce(nullif(handle, ''), nullif(uid, ''), nullif(display, ''), 'playlist_' || id)"
SHOWN = f"""wts AS (SELECT vec_id AS song_id, 1.0::DOUBLE + vec_id % 4 AS w FROM embeddings), ps AS (SELECT song_id, w / sum(w) OVER () AS p FROM wts),
  slots AS (SELECT song_id, row_number() OVER (ORDER BY song_id) - 1 AS slot, round(p * 1099511627776)::HUGEINT AS w, count(*) OVER () AS n, sum(round(p * 1099511627776)::HUGEINT) OVER () AS total FROM ps),
  sums AS (SELECT *, n * w AS own, n * w - total AS over, coalesce(sum(greatest(total - n * w, 0)) OVER b, 0) AS lack, coalesce(sum(greatest(n * w - total, 0)) OVER b, 0) AS spare FROM slots WINDOW b AS (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  line AS (SELECT spare + over AS pos, 0 AS kind, slot, song_id AS heavy, NULL AS fin FROM sums WHERE over > 0 UNION ALL SELECT lack, 1, slot, NULL, NULL FROM sums WHERE over < 0 UNION ALL SELECT lack - over, 2, slot, NULL, lack - over FROM sums WHERE over < 0),
  nexts AS (SELECT *, first_value(heavy IGNORE NULLS) OVER f AS other, first_value(fin IGNORE NULLS) OVER f AS drawn FROM line WINDOW f AS (ORDER BY pos, kind, slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  alias AS (SELECT s.slot, song_id, (CASE WHEN kind = 0 THEN total - (coalesce(drawn, pos) - pos) WHEN kind = 1 THEN own ELSE total END)::DOUBLE / total::DOUBLE AS keep, coalesce(other, song_id) AS other FROM sums s LEFT JOIN (SELECT * FROM nexts WHERE kind < 2) x ON x.slot = s.slot),
  draws AS (SELECT floor({uniform('42/imp/slot', 'user_id', 'd')} * (SELECT count(*) FROM ps))::BIGINT AS slot, user_id, {uniform('42/imp/side', 'user_id', 'd')} AS u FROM (SELECT DISTINCT user_id FROM events), range(1, 51) AS r(d)),
  shown AS (SELECT DISTINCT user_id, CASE WHEN u < keep THEN song_id ELSE other END AS song_id FROM draws JOIN alias USING (slot))"""
NEGATIVES = f"""neg AS (SELECT user_id, song_id FROM shown ANTI JOIN hist USING (user_id, song_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {uniform('42/neg', 'user_id', 'song_id')}, song_id) <= 10)"""
EXAMPLES = f"""{HISTORY}, {VECTORS}, {MEANS}, {SHOWN}, {NEGATIVES}, ex AS (SELECT user_id, song_id, label, round(list_dot_product(m, u.v), 6) AS score FROM (SELECT DISTINCT user_id, song_id, 1 AS label FROM hist UNION ALL SELECT user_id, song_id, 0 FROM neg) JOIN (SELECT song_id, v FROM unit) u USING (song_id) JOIN umeans USING (user_id))"""


def mixing(columns: str, start: str) -> str:
    return f"""WITH {LAST50}, flag AS (SELECT *, ts >= TIMESTAMP '{start}' AS new FROM l50), halves AS (SELECT *, max(new) OVER (PARTITION BY user_id) AS mixed, row_number() OVER (PARTITION BY user_id, new ORDER BY seq DESC) AS back FROM flag),
      kept AS (SELECT * FROM halves WHERE NOT mixed OR back <= 25 QUALIFY row_number() OVER (PARTITION BY user_id, song_id ORDER BY seq DESC) = 1)
      SELECT {columns}, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS place FROM kept QUALIFY place <= 50"""


SHARE = "('0.' || lpad((floor(value)::BIGINT % 100)::VARCHAR, 2, '0'))::DOUBLE"


def answer(name: str) -> str:
    given = {"content_usefulness": SHARE, "production_quality": "0.8", "content_enjoyment": "1.7"}.get(name, "0.5")
    spoken = {"content_usefulness": SHARE, "production_quality": "0.25"}.get(name, "0.5")
    return f"round(least(1.0, greatest(0.0, CASE WHEN event_id % 3 = 0 THEN {given} WHEN event_id % 3 = 1 THEN {spoken} ELSE 0.5 END)), 6)::DOUBLE"


NAMES = ("content_usefulness", "production_quality", "content_enjoyment", "production_complexity", "overall_recommendation_score")
PROMPT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"

def prompt_pool(last: int = 16) -> str:
    """poolp(user_id, song_id, normal, score, seeds): the prompt channel's candidates."""
    return rf"""own AS (SELECT DISTINCT user_id, song_id FROM (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= {last})),
      songs AS (SELECT song_id, label AS creator, {PROMPT} AS normal FROM vec JOIN documents ON doc_id = song_id), sh AS (SELECT song_id, [x + 0.15 FOR x IN v] AS v FROM unit), su AS (SELECT song_id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS v FROM sh),
      nearp AS (SELECT a.song_id AS q, b.song_id, round(list_dot_product(a.v, b.v), 6) AS sim FROM (SELECT * FROM su WHERE song_id IN (SELECT song_id FROM own)) a, su b QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, b.song_id) <= 21),
      metp AS (SELECT o.user_id, q, n.song_id, round(1 - sqrt(greatest(0.0, 2 - 2 * sim)), 6) AS s FROM own o JOIN nearp n ON n.q = o.song_id AND n.song_id <> q),
      artists AS (SELECT DISTINCT user_id, creator FROM own JOIN songs USING (song_id)),
      okp AS (SELECT user_id, q, song_id, normal, s FROM metp JOIN songs USING (song_id) ANTI JOIN own USING (user_id, song_id) ANTI JOIN artists USING (user_id, creator) WHERE s > 0 AND normal <> '' QUALIFY row_number() OVER (PARTITION BY user_id, q, normal ORDER BY s DESC, song_id) = 1),
      scoredp AS (SELECT user_id, song_id, normal, round(sum(s), 6) AS score, list(DISTINCT q ORDER BY q) AS seeds FROM okp GROUP BY 1, 2, 3),
      poolp AS (SELECT * FROM scoredp QUALIFY row_number() OVER (PARTITION BY user_id, normal ORDER BY score DESC, song_id) = 1)"""


def taste(seeds: str) -> str:
    """The shares of genres and tags of seeds (user_id, song_id), over eng."""
    return f"""liked AS (SELECT s.user_id, e.* FROM {seeds} s JOIN eng e USING (song_id)),
      size AS (SELECT user_id, count(*) AS size, min(popularity_score) AS lo, max(popularity_score) AS hi, avg(popularity_score) AS mean FROM liked GROUP BY 1), genres AS (SELECT user_id, genre, count(*) AS g FROM liked GROUP BY 1, 2),
      tags AS (SELECT user_id, tag, count(*) AS t FROM (SELECT user_id, unnest(tags) AS tag FROM liked) GROUP BY 1, 2), total AS (SELECT user_id, sum(t) AS total FROM tags GROUP BY 1)"""


def content_knn(seeds: str, n: int = 10) -> str:
    """knn(user_id, song_id, score, similarity, match, rank)."""
    return f"""cown AS (SELECT DISTINCT user_id, song_id FROM {seeds}), cvec AS (SELECT song_id, v FROM unit SEMI JOIN cat USING (song_id)), cseeds AS (SELECT * FROM cown SEMI JOIN cvec USING (song_id)),
      cmean AS (SELECT user_id, list(x ORDER BY i) AS m FROM (SELECT user_id, i, avg(x) AS x FROM (SELECT user_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM cseeds JOIN cvec USING (song_id)) GROUP BY 1, 2) GROUP BY 1),
      cnear AS (SELECT user_id, song_id, round(list_dot_product(m, v) / sqrt(list_dot_product(m, m)), 6) AS sim FROM cmean, cvec QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, song_id) <= {3 * n}),
      cmet AS (SELECT user_id, song_id, round(1 - sqrt(greatest(0.0, 2 - 2 * sim)), 6) AS similarity FROM cnear ANTI JOIN cown USING (user_id, song_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, song_id) <= {n}),
      {taste('cseeds')}, ctag AS (SELECT user_id, song_id, sum(t) AS t FROM (SELECT user_id, song_id, unnest(tags) AS tag FROM cmet JOIN eng USING (song_id)) JOIN tags USING (user_id, tag) GROUP BY 1, 2),
      cmatch AS (SELECT c.user_id, c.song_id, similarity, round(0.2 * coalesce(g, 0) / size + 0.15 * coalesce(t / total, 0) + 0.05 * CASE WHEN popularity_score BETWEEN lo AND hi THEN 1.0 ELSE 1 / (1 + least(abs(popularity_score - lo), abs(popularity_score - hi)) / (mean + 1e-8)) END, 6) AS match
        FROM cmet c JOIN eng e USING (song_id) JOIN size USING (user_id) LEFT JOIN total USING (user_id) LEFT JOIN genres x ON x.user_id = c.user_id AND x.genre = e.genre LEFT JOIN ctag y ON y.user_id = c.user_id AND y.song_id = c.song_id),
      knn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) AS rank FROM (SELECT user_id, song_id, round(0.6 * similarity + 0.4 * match, 6) AS score, similarity, match FROM cmatch))"""


TOWERS = """tower AS (SELECT user_id, song_id, score FROM (SELECT user_id, song_id, round(list_dot_product(m, v), 6) AS score FROM umeans, unit) ANTI JOIN hist USING (user_id, song_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) <= 30)"""
FOUR = """chan4 AS (SELECT user_id, song_id, 'item_cf' AS channel, round(score * 0.25, 8) AS s FROM item_cf UNION ALL SELECT user_id, song_id, 'user_based', round(score * 0.25, 8) FROM user_cf UNION ALL SELECT user_id, song_id, 'two_tower', round(score * 0.35, 8) FROM tower
    UNION ALL SELECT user_id, song_id, 'prompt_based', round(score * 0.15, 8) FROM (SELECT * FROM poolp QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) <= 30)),
  blend4 AS (SELECT user_id, song_id, round(sum(s), 8) AS recall_score, (list(channel ORDER BY s DESC, channel))[1] AS primary_channel FROM chan4 GROUP BY 1, 2),
  coarse AS (SELECT b.*, coalesce(quality_score, 0.3) AS quality_score FROM blend4 b LEFT JOIN quality USING (song_id) WHERE coalesce(quality_score, 0.3) >= 0.3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY recall_score DESC, song_id) <= 50),
  clicks AS (SELECT c.user_id, c.song_id, round(1 / (1 + exp(-round(list_dot_product(m, v), 6))), 6) AS ctr FROM coarse c JOIN umeans USING (user_id) JOIN unit USING (song_id)),
  fine AS (SELECT c.*, round(coalesce(ctr, recall_score), 8) AS fine_score FROM coarse c LEFT JOIN clicks USING (user_id, song_id)),
  final AS (SELECT f.*, round(CASE WHEN p_size IS NULL THEN fine_score ELSE 0.8 * fine_score + 0.2 * (p_size / 50) END, 8) AS final_score FROM (SELECT * FROM fine QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY fine_score DESC, song_id) <= 50) f LEFT JOIN (SELECT * FROM part WHERE p_size % 2 = 0) ON p_partkey = song_id)"""
SEEDS8 = "seeds8 AS (SELECT user_id, song_id FROM plays QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 8)"


# The neighbour index: leaders by hash, and each vector's leaders from the nearest.
INDEX = f"""{VECTORS}, leaders AS (SELECT v, row_number() OVER (ORDER BY song_id) AS cell FROM (SELECT * FROM unit ORDER BY md5('leaders|' || song_id), song_id LIMIT (SELECT ceil(sqrt(count(*)))::BIGINT FROM unit))),
  lead AS (SELECT song_id, cell, row_number() OVER (PARTITION BY song_id ORDER BY round(list_dot_product(u.v, l.v), 6) DESC, cell) AS nth FROM unit u, leaders l),
  dots AS (SELECT x.song_id AS q, y.song_id, round(list_dot_product(x.v, y.v), 6) AS sim FROM unit x JOIN unit y ON x.song_id <> y.song_id),
  met AS (SELECT a.song_id AS q, b.song_id, min(a.nth) AS probes FROM lead a JOIN lead b ON a.cell = b.cell AND b.nth <= 2 AND a.song_id <> b.song_id GROUP BY 1, 2)"""


def probed(cells: str) -> str:
    return f"SELECT q, song_id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, song_id) AS rank FROM dots JOIN met USING (q, song_id) WHERE probes <= {cells} QUALIFY rank <= 10"


ORACLES: dict[str, str] = {
    "ui_from_playlists": f"WITH {PLAYLISTS} SELECT id AS user_id, song_id, count(*)::DOUBLE AS weight FROM entries SEMI JOIN part ON p_partkey = song_id GROUP BY 1, 2",
    "ui_from_creators": "SELECT p_brand AS user_id, p_partkey AS song_id, count(*)::DOUBLE AS weight FROM part GROUP BY 1, 2",
    "ui_creator_priority": f"WITH {PLAYLISTS} SELECT DISTINCT {MEMBERS} AS user_id, song_id, 1.0::DOUBLE AS weight FROM entries SEMI JOIN part ON p_partkey = song_id",
    "multi_playlist_creators": f"WITH {PLAYLISTS} SELECT coalesce(nullif(handle, ''), nullif(display, ''), 'playlist_' || id) AS creator, count(DISTINCT id) AS playlists, count(DISTINCT song_id) AS songs FROM entries GROUP BY 1 HAVING playlists > 1 ORDER BY playlists DESC, creator LIMIT 10",
    "active_users": f"WITH {LIKES} SELECT user_id, count(*) AS songs FROM likes GROUP BY 1 HAVING count(*) >= 3",
    "ui_as_history": f"WITH {LIKES} SELECT user_id, song_id, TIMESTAMP '2024-01-24 10:00:00' - to_days((count(*) OVER (PARTITION BY user_id) - i + 1)::INT) AS ts, 1.0::DOUBLE AS weight, 'like' AS type, i AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY song_id) AS i FROM likes)",
    "cold_songs": "SELECT p_partkey AS song_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)",
    "item_item_cosine_topk": top_sims(ITEM_SIMS, 5),
    "item_item_weighted_cosine": top_sims(f"{UI}, {cosine('ui', 'song_id', 'user_id', 'weight')}", 5),
    "user_user_cosine_topk": top_sims(USER_SIMS, 5),
    "item_cf_recommend": f"WITH {ITEM_SIMS}, {PLAYS}, {item_cf(10)} SELECT user_id, song_id, score, seeds, primary_seed, rank FROM item_cf",
    "user_cf_recommend": f"WITH {LIKES}, {ONES}, {USIMS}, {PLAYS}, {user_cf(10)} SELECT user_id, song_id, source_user, score, rank FROM user_cf",
    "virtual_user_recommend": f"""WITH {LIKES}, {CATALOG}, own AS (SELECT creator AS user_id, song_id FROM cat QUALIFY row_number() OVER (PARTITION BY creator ORDER BY play_count DESC, song_id) <= 5),
      norms AS (SELECT user_id AS other, sqrt(count(*)) AS norm FROM likes GROUP BY 1), sizes AS (SELECT user_id, count(*) AS size FROM own GROUP BY 1),
      near AS (SELECT user_id, other, round(dot / (sqrt(size) * norm), 6) AS sim FROM (SELECT o.user_id, l.user_id AS other, count(*)::DOUBLE AS dot FROM own o JOIN likes l USING (song_id) GROUP BY 1, 2) JOIN norms USING (other) JOIN sizes USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, other) <= 20),
      scored AS (SELECT n.user_id, l.song_id, round(sum(sim), 6) AS score FROM near n JOIN likes l ON l.user_id = n.other GROUP BY 1, 2)
      SELECT user_id, song_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) AS rank FROM scored ANTI JOIN own USING (user_id, song_id) QUALIFY rank <= 10""",
    "similar_songs_colike": f"""WITH {LIKES}, pairs AS (SELECT x.song_id AS a, y.song_id AS b, count(*) AS n FROM likes x JOIN likes y ON x.user_id = y.user_id AND x.song_id <> y.song_id GROUP BY 1, 2)
      SELECT a, b, round(n / max(n) OVER (PARTITION BY a), 6) AS score, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM pairs QUALIFY rank <= 10""",
    "similar_songs_item_cf": top_sims(ITEM_SIMS, 10),
    "popular_fallback": f"WITH {ENGAGED}, t AS (SELECT song_id, popularity_score FROM eng ORDER BY popularity_score DESC, song_id LIMIT 20) SELECT song_id, round(popularity_score / max(popularity_score) OVER (), 6) AS score FROM t",
    "cold_start_fill": f"""WITH {ITEM_SIMS}, {PLAYS}, {item_cf(2)}, {ENGAGED}, t AS (SELECT song_id, popularity_score FROM eng ORDER BY popularity_score DESC, song_id LIMIT 12), pop AS (SELECT song_id, round(popularity_score / max(popularity_score) OVER (), 6) AS score FROM t),
      both_parts AS (SELECT user_id, song_id, score, 0 AS part FROM item_cf UNION ALL SELECT user_id, song_id, round(score * 0.5, 7), 1 FROM (SELECT user_id, pop.song_id, pop.score FROM (SELECT DISTINCT user_id FROM item_cf), pop) ANTI JOIN item_cf USING (user_id, song_id))
      SELECT user_id, song_id, score, row_number() OVER (PARTITION BY user_id ORDER BY part, score DESC, song_id) AS rank FROM both_parts QUALIFY rank <= 10""",
    "last_n_history": f"WITH {LAST50} SELECT user_id, song_id, ts, weight, type, seq FROM l50",
    "streamed_history": f"WITH {STREAM} SELECT * EXCLUDE (seq, back), row_number() OVER (PARTITION BY user_id ORDER BY seq) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS back FROM stream) WHERE back <= 50",
    "streamed_weekly_lists": f"""WITH {STREAM}, ends AS (SELECT user_id, date_trunc('week', ts) + INTERVAL 7 DAY AS week_end FROM stream GROUP BY 1, 2 HAVING week_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM stream)),
      last AS (SELECT s.*, week_end, ts >= week_end - INTERVAL 7 DAY AS new FROM ends JOIN stream s USING (user_id) WHERE ts < week_end QUALIFY row_number() OVER (PARTITION BY user_id, week_end ORDER BY seq DESC) <= 50),
      halves AS (SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY user_id, week_end, new ORDER BY seq DESC) <= 25),
      latest AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY user_id, week_end, song_id ORDER BY seq DESC) = 1)
      SELECT * EXCLUDE (seq, new), row_number() OVER (PARTITION BY user_id, week_end ORDER BY seq DESC) AS place FROM latest""",
    "weekly_mixing": mixing("user_id, song_id", "2024-01-22 00:00:00"),
    "weekly_mixing_weights": mixing("user_id, song_id, weight, seq", "2024-01-22 10:00:00"),
    "update_due": "SELECT user_id, max(ts) IS NULL OR date_trunc('week', max(ts)) < TIMESTAMP '2024-01-29' AS due, false AS due_midweek FROM events GROUP BY 1",
    "history_users": "SELECT user_id, count(*) AS rows FROM events GROUP BY 1",
    "engagement_processed": f"WITH {ENGAGED} SELECT song_id, engagement_rate, popularity_score FROM eng",
    "engagement_aggregated": f"WITH {CATALOG} SELECT song_id, CASE WHEN play_count > 0 THEN round(upvote_count / play_count, 6) ELSE 0 END AS engagement_rate, play_count::DOUBLE AS popularity_score FROM cat",
    "tag_extract": "SELECT p_partkey AS song_id, array_to_string(list_sort(list_distinct([lower(trim(x)) FOR x IN string_split(replace(p_name, ' ', ' , ') || ',' || p_type, ',') IF trim(x) <> ''])), '|') AS tags FROM part",
    "tag_parse_rules": r"""WITH t AS (SELECT doc_id AS song_id, CASE doc_id % 3 WHEN 0 THEN replace(text, ',', '') WHEN 1 THEN regexp_replace(text, '[,.]', '', 'g') ELSE text END AS x FROM documents),
      s AS (SELECT song_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS whole, CASE WHEN contains(x, ',') THEN list_filter(list_transform(string_split(x, ','), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: length(y) > 0)
        WHEN contains(x, '.') THEN list_filter(list_transform(string_split(x, '.'), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: length(y) > 2) ELSE list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '') END AS p FROM t),
      r AS (SELECT song_id, CASE WHEN whole = '' THEN [] WHEN len(p) = 0 OR (len(p) = 1 AND length(p[1]) > 50) THEN [whole] ELSE p END AS tags FROM s)
      SELECT song_id, len(tags) AS n, coalesce(nullif(substr(tags[1], 1, 50), ''), 'unknown') AS genre, md5(coalesce(array_to_string(tags, '|'), '')) AS tags_md5 FROM r""",
    "genre_keyword": """WITH t AS (SELECT p_partkey AS song_id, replace(p_name || ' ' || lower(p_type), 'blue', 'blues') AS j FROM part)
      SELECT song_id, CASE WHEN contains(j, 'pop') THEN 'pop' WHEN contains(j, 'rock') OR contains(j, 'post-hardcore') THEN 'rock' WHEN contains(j, 'hip hop') OR contains(j, 'hip-hop') OR contains(j, 'rap') THEN 'hip hop'
      WHEN contains(j, 'edm') OR contains(j, 'electronic') OR contains(j, 'synth') OR contains(j, 'glitch') OR contains(j, 'phonk') THEN 'electronic' WHEN contains(j, 'jazz') OR contains(j, 'blues') THEN 'jazz'
      WHEN contains(j, 'r&b') OR contains(j, 'r and b') OR contains(j, 'soul') THEN 'r&b' WHEN contains(j, 'country') OR contains(j, 'folk') THEN 'country' WHEN contains(j, 'classical') OR contains(j, 'orchestral') THEN 'classical'
      WHEN contains(j, 'metal') THEN 'metal' WHEN contains(j, 'reggae') OR contains(j, 'dancehall') THEN 'reggae' WHEN contains(j, 'latin') OR contains(j, 'salsa') THEN 'latin' END AS genre FROM t""",
    "prompt_features": r"""SELECT doc_id AS song_id, length(coalesce(text, '')) AS prompt_length, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda y: y <> '')) AS word_count,
      len(regexp_extract_all(coalesce(text, ''), '(?i)\[verse')) AS verse_count, len(regexp_extract_all(coalesce(text, ''), '(?i)\[chorus')) AS chorus_count, len(regexp_extract_all(coalesce(text, ''), '(?i)\[bridge')) AS bridge_count,
      verse_count > 0 OR chorus_count > 0 AS has_structure FROM documents""",
    "prompt_dedup_best": f"SELECT doc_id AS song_id, n_chars % 97 AS score FROM documents QUALIFY row_number() OVER (PARTITION BY {PROMPT} ORDER BY n_chars % 97 DESC, doc_id) = 1",
    "tag_stats": "WITH n AS (SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1) SELECT tag, n, round(n / sum(n) OVER (), 6) AS share FROM n",
    "metadata_zscore_onehot": f"""WITH {ENGAGED}, g AS (SELECT list(DISTINCT genre ORDER BY genre) AS genres FROM cat), s AS (SELECT avg(duration) md, stddev_pop(duration) sd, avg(popularity_score) mp, stddev_pop(popularity_score) sp, avg(engagement_rate) me, stddev_pop(engagement_rate) se FROM eng)
      SELECT song_id, round((duration - md) / (sd + 1e-8), 6) AS z_duration, round((popularity_score - mp) / (sp + 1e-8), 6) AS z_popularity_score, round((engagement_rate - me) / (se + 1e-8), 6) AS z_engagement_rate,
      array_to_string([CASE WHEN x = genre THEN '1' ELSE '0' END FOR x IN genres], '') AS one_hot FROM eng, g, s""",
    "vector_l2_normalize": "WITH c AS (SELECT vec_id AS song_id, (embedding::DOUBLE[])[1:48] AS v FROM embeddings) SELECT song_id, len(v) AS size, 1.0::DOUBLE AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, 1.0::DOUBLE AS square FROM c",
    "html_genre_scrape": r"SELECT DISTINCT genre FROM (SELECT lower(regexp_replace(unnest(regexp_extract_all(html, '<(?:h1|h2|h3)[^>]*>([^<]+)<', 1)), '^\s+|\s+$', '', 'g')) AS genre FROM pages) WHERE genre <> ''",
    "catalog_metadata": "SELECT (SELECT count(*) FROM part) AS total_songs, (SELECT count(DISTINCT p_brand) FROM part) AS unique_users, lower(p_type) AS genre, count(*) AS n FROM part GROUP BY 3",
    "quality_heuristic": f"WITH {QUALITY} SELECT song_id, quality_score FROM quality",
    "quality_filter_boost": f"WITH {QUALITY} SELECT song_id, quality_score, round(popularity_score * (0.7 + 0.3 * quality_score), 6) AS boosted FROM quality JOIN eng USING (song_id) WHERE quality_score >= 0.3",
    "quality_summary": f"""WITH {QUALITY} SELECT count(*) AS songs, min(quality_score) AS lowest, max(quality_score) AS highest, round(avg(quality_score), 6) AS mean, round(median(quality_score), 6) AS median, round(stddev_pop(quality_score), 6) AS std,
      round(count(*) FILTER (quality_score >= 0.3) / count(*), 6) AS pass_rate, count(*) FILTER (quality_score >= 0.7) AS high, count(*) FILTER (quality_score >= 0.4 AND quality_score < 0.7) AS medium, count(*) FILTER (quality_score < 0.4) AS low FROM quality""",
    "quality_json_paths": "SELECT event_id, printf('%.3f', value)::DOUBLE AS quality_score FROM events WHERE event_id % 5 <> 4",
    "llm_score_parse": "SELECT event_id, " + ", ".join(f"{answer(n)} AS {n}" for n in NAMES) + " FROM events",
    "llm_overall": "SELECT event_id, round(" + " + ".join(f"{w} * {answer(n)}" for n, w in zip(NAMES, (0.15, 0.30, 0.25, 0.10, 0.20), strict=True)) + ", 6)::DOUBLE AS overall FROM events",
    "user_mean_vector": f"WITH {HISTORY}, {VECTORS}, {MEANS} SELECT user_id, i - 1 AS i, round(x, 6) AS x FROM mv",
    "two_tower_identity_topk": f"""WITH {HISTORY}, {VECTORS}, {MEANS} SELECT user_id, song_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) AS rank FROM (SELECT user_id, song_id, round(list_dot_product(m, v), 6) AS score FROM umeans, unit) ANTI JOIN hist USING (user_id, song_id) QUALIFY rank <= 10""",
    "user_row": f"WITH {LIKES} SELECT user_id, song_id, 1.0::DOUBLE AS weight FROM likes WHERE user_id = (SELECT user_id FROM likes GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)",
    "dense_similar_items": f"WITH {VECTORS} SELECT q, song_id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, song_id) AS rank FROM (SELECT a.song_id AS q, b.song_id, round(list_dot_product(a.v, b.v), 6) AS sim FROM unit a JOIN unit b ON a.song_id <> b.song_id) QUALIFY rank <= 10",
    "prompt_channel_candidates": f"WITH {HISTORY}, {VECTORS}, {prompt_pool()} SELECT user_id, song_id, score, array_to_string(seeds, ',') AS seeds FROM poolp",
    "prompt_channel_greedy": f"""WITH RECURSIVE {HISTORY}, {VECTORS}, {prompt_pool()}, c AS MATERIALIZED (SELECT user_id, song_id, score, seeds, md5(normal) AS p, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) AS pos FROM poolp),
      g AS (SELECT DISTINCT user_id, 0::BIGINT AS pos, []::BIGINT[] AS used, []::VARCHAR[] AS prompts, 0::BIGINT AS n, NULL::BIGINT AS song_id, NULL::DOUBLE AS score, false AS take FROM c UNION ALL
        SELECT user_id, pos, CASE WHEN take THEN list_concat(used, seeds) ELSE used END, CASE WHEN take THEN list_append(prompts, p) ELSE prompts END, n + take::INT, song_id, score, take FROM
          (SELECT g.user_id, c.pos, used, prompts, n, c.song_id, c.score, c.seeds, c.p, n < 10 AND NOT list_has_all(used, c.seeds) AND NOT list_contains(prompts, c.p) AS take FROM g JOIN c ON c.user_id = g.user_id AND c.pos = g.pos + 1))
      SELECT user_id, song_id, score, n AS rank FROM g WHERE take""",
    "content_knn": f"WITH {ENGAGED}, {PLAYS}, {VECTORS}, {SEEDS8}, {content_knn('seeds8')} SELECT * FROM knn",
    "content_similar_songs": f"WITH {VECTORS} SELECT a, b, round(1 - sqrt(greatest(0.0, 2 - 2 * sim)), 6) AS score, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM (SELECT x.song_id AS a, y.song_id AS b, round(list_dot_product(x.v, y.v), 6) AS sim FROM unit x JOIN unit y ON x.song_id <> y.song_id) QUALIFY rank <= 10",
    "cold_seeds_fallback": f"""WITH {LIKES}, few AS (SELECT * FROM likes WHERE song_id % 3 > 0), ones AS (SELECT *, 1.0::DOUBLE AS w FROM few), {cosine('ones', 'song_id', 'user_id', 'w')}, {PLAYS}, {ENGAGED}, {VECTORS},
      own2 AS (SELECT user_id, song_id FROM plays QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 2), near AS (SELECT a AS seed, b AS song_id, sim FROM sims QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 5),
      wseeds AS (SELECT * FROM own2 SEMI JOIN few USING (song_id)), scored AS (SELECT s.user_id, n.song_id, round(sum(sim), 6) AS score FROM wseeds s JOIN near n ON n.seed = s.song_id GROUP BY 1, 2),
      warm AS (SELECT * FROM scored ANTI JOIN wseeds USING (user_id, song_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) <= 10), {content_knn('own2')}
      SELECT user_id, song_id, score FROM warm ANTI JOIN own2 USING (user_id, song_id) UNION ALL SELECT user_id, song_id, score FROM knn WHERE user_id NOT IN (SELECT user_id FROM wseeds)""",
    "hybrid_full": f"WITH {TWO}, {QUALITY}, {HISTORY}, {VECTORS}, {MEANS}, {TOWERS}, {prompt_pool()}, {FOUR} SELECT user_id, song_id, recall_score, quality_score, fine_score, final_score, primary_channel, row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, song_id) AS rank FROM final QUALIFY rank <= 10",
    "prompt_index_search": f"WITH {HISTORY}, {INDEX}, wanted AS (SELECT DISTINCT song_id AS q FROM (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 16)) SELECT * FROM ({probed('8')}) SEMI JOIN wanted USING (q)",
    "similar_prompts": f"WITH {INDEX} SELECT q AS a, song_id AS b, round(1 - sqrt(greatest(0.0, 2 - 2 * sim)), 6) AS score, rank FROM ({probed('16')})",
    "index_recall": f"""WITH {INDEX}, sample AS (SELECT song_id AS q FROM unit ORDER BY md5('audit|' || song_id), song_id LIMIT 256), p(probes) AS (VALUES (4), (8), (16), (32), (64)),
      best AS (SELECT * FROM dots SEMI JOIN sample USING (q) QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, song_id) <= 10),
      got AS (SELECT p.probes, q, song_id, true AS got FROM p, dots JOIN met USING (q, song_id) SEMI JOIN sample USING (q) WHERE met.probes <= p.probes QUALIFY row_number() OVER (PARTITION BY p.probes, q ORDER BY sim DESC, song_id) <= 10)
      SELECT p.probes, count(DISTINCT best.q) AS queries, count(*) AS wanted, count(got) AS found, round(count(got) / count(*), 6) AS recall FROM p CROSS JOIN best LEFT JOIN got ON got.probes = p.probes AND got.q = best.q AND got.song_id = best.song_id GROUP BY 1""",
    "similar_songs_hybrid": f"""WITH {ITEM_SIMS}, {VECTORS}, parts AS (SELECT a, b, round(sim * 0.25, 8) AS s FROM (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 20)
      UNION ALL SELECT a, b, round(round(n / max(n) OVER (PARTITION BY a), 6) * 0.25, 8) FROM (SELECT x.song_id AS a, y.song_id AS b, count(*) AS n FROM likes x JOIN likes y ON x.user_id = y.user_id AND x.song_id <> y.song_id GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) <= 20
      UNION ALL SELECT a, b, round(sim * 0.35, 8) FROM (SELECT x.song_id AS a, y.song_id AS b, round(list_dot_product(x.v, y.v), 6) AS sim FROM unit x JOIN unit y ON x.song_id <> y.song_id QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 20))
      SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM (SELECT a, b, round(sum(s), 8) AS score FROM parts GROUP BY 1, 2) QUALIFY rank <= 10""",
    "explained_channels": f"""WITH {TWO} SELECT user_id, 'item-based CF' AS channel, rank, song_id, score, primary_seed::VARCHAR AS because FROM item_cf WHERE rank <= 5 UNION ALL SELECT user_id, 'user-based CF', rank, song_id, score, source_user::VARCHAR FROM user_cf WHERE rank <= 5""",
    "interactions_merged": f"WITH {UI} SELECT user_id, song_id, least(1.0, greatest(0.4, weight::DOUBLE / 50))::DOUBLE AS weight FROM ui",
    "permutation_test": f"WITH {LIKES} SELECT count(DISTINCT user_id) AS users, count(DISTINCT song_id) AS items, count(*) AS pairs, count(*) > 0 AND count(DISTINCT user_id) = count(*) AND count(DISTINCT song_id) = count(*) AS is_permutation FROM likes",
    "latest_items": f"""WITH {LIKES}, {HISTORY}, told AS (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS place, 'history' AS source FROM hist QUALIFY place <= 20),
      made AS (SELECT p_partkey AS song_id, CASE WHEN p_size > 20 THEN p_size END AS age FROM part), rest AS (SELECT l.user_id, l.song_id, age, count(age) OVER (PARTITION BY l.user_id) > 0 AS dated FROM likes l LEFT JOIN made USING (song_id) WHERE l.user_id NOT IN (SELECT user_id FROM hist))
      SELECT * FROM told UNION ALL SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY age NULLS LAST, song_id) AS place, CASE WHEN dated THEN 'created' ELSE 'order' END AS source FROM rest QUALIFY place <= 20""",
    "user_activity": f"WITH {LIKES} SELECT user_id, floor(3 + (list_sort([{', '.join(uniform(f'42/{i}', 'user_id') for i in range(6))}]))[2] * 47)::INT AS k FROM (SELECT DISTINCT user_id FROM likes)",
    "single_user_items": f"""WITH {LIKES}, o AS (SELECT p_partkey AS song_id, row_number() OVER (ORDER BY {uniform('42', 'p_partkey')}, p_partkey) AS i, count(*) OVER () AS n FROM part), single AS (SELECT song_id FROM o WHERE i > floor(n * 0.05) AND i <= floor(n * 0.05) + floor(n * 0.15)),
      u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM likes)) SELECT user_id, song_id, 1.0::DOUBLE AS weight FROM (SELECT song_id FROM single WHERE song_id NOT IN (SELECT song_id FROM likes WHERE song_id % 2 = 0)) JOIN u ON i = floor({uniform('42/single', 'song_id')} * n)""",
    "din_training_set": f"""WITH {HISTORY}, {SHOWN}, {NEGATIVES}, ex AS (SELECT DISTINCT user_id, song_id, 1 AS label FROM hist UNION ALL SELECT user_id, song_id, 0 FROM neg), l AS (SELECT user_id, list(song_id ORDER BY seq) AS songs FROM (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 13) GROUP BY 1),
      m AS (SELECT ex.*, list_filter(coalesce(songs, []), lambda x: label = 0 OR x <> song_id) AS own FROM ex LEFT JOIN l USING (user_id)), h AS (SELECT *, own[greatest(1, len(own) - 11):len(own)] AS hist FROM m)
      SELECT user_id, song_id, label, array_to_string(list_concat(hist::VARCHAR[], ['-' FOR i IN range(12 - len(hist))]), ',') AS hist, len(hist) AS size FROM h WHERE len(hist) > 0 OR label = 0""",
    "content_match": f"""WITH {ENGAGED}, {PLAYS}, seeds AS (SELECT user_id, song_id FROM plays QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 8), liked AS (SELECT s.user_id, e.* FROM seeds s JOIN eng e USING (song_id)),
      size AS (SELECT user_id, count(*) AS size, min(popularity_score) AS lo, max(popularity_score) AS hi, avg(popularity_score) AS mean FROM liked GROUP BY 1), genres AS (SELECT user_id, genre, count(*) AS g FROM liked GROUP BY 1, 2),
      tags AS (SELECT user_id, tag, count(*) AS t FROM (SELECT user_id, unnest(tags) AS tag FROM liked) GROUP BY 1, 2), total AS (SELECT user_id, sum(t) AS total FROM tags GROUP BY 1),
      tagged AS (SELECT user_id, song_id, sum(t) AS t FROM (SELECT song_id, unnest(tags) AS tag FROM eng) JOIN tags USING (tag) GROUP BY 1, 2), bg AS (SELECT user_id, song_id, g FROM eng JOIN genres USING (genre)),
      met AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.song_id, b.song_id) AS song_id, t, g FROM tagged a FULL JOIN bg b ON a.user_id = b.user_id AND a.song_id = b.song_id),
      scored AS (SELECT user_id, song_id, round(0.2 * coalesce(g, 0) / size + 0.15 * coalesce(t / total, 0) + 0.05 * CASE WHEN popularity_score BETWEEN lo AND hi THEN 1.0 ELSE 1 / (1 + least(abs(popularity_score - lo), abs(popularity_score - hi)) / (mean + 1e-8)) END, 6) AS score
        FROM met JOIN size USING (user_id) LEFT JOIN total USING (user_id) JOIN eng USING (song_id))
      SELECT user_id, song_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, song_id) AS rank FROM scored ANTI JOIN seeds USING (user_id, song_id) QUALIFY rank <= 10""",
    "incremental_embedding_anti_join": "SELECT p_partkey AS song_id FROM part ANTI JOIN embeddings ON vec_id = p_partkey",
    "hybrid_blend": f"WITH {TWO}, {BLEND} SELECT user_id, song_id, recall_score, primary_channel FROM blend",
    "hybrid_pipeline": f"WITH {TWO}, {BLEND}, {QUALITY}, {RECOMMENDED} SELECT * FROM recommended",
    "channel_attribution": f"WITH {TWO}, {BLEND}, {QUALITY}, {RECOMMENDED} SELECT primary_channel, count(*) AS n, min(fine_score) AS lowest, max(fine_score) AS highest, round(avg(fine_score), 6) AS mean FROM recommended GROUP BY 1",
    "llm_rerank": f"""WITH {ITEM_SIMS}, {PLAYS}, {item_cf(50)}, f AS (SELECT user_id, i.song_id, score AS fine_score, round(CASE WHEN p_size > 10 THEN 0.8 * score + 0.2 * (p_size / 50) ELSE score END, 8) AS final_score FROM item_cf i JOIN part ON p_partkey = song_id)
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC, song_id) AS rank FROM f QUALIFY rank <= 10""",
    "popularity_weights": f"""WITH {ENGAGED}, w AS (SELECT song_id, pow(popularity_score / (SELECT max(popularity_score) FROM eng) + 0.1, 2) * exp(0.3 * sqrt(-2 * ln(greatest({uniform('42/r', 'song_id')}, 1e-10))) * cos(2 * pi() * {uniform('42/a', 'song_id')})) AS w FROM eng)
      SELECT song_id, round(w / sum(w) OVER (), 9) AS p FROM w""",
    "genre_preferences": f"""WITH {LIKES}, n AS (SELECT user_id, lower(p_type) AS genre, count(*) AS n FROM likes JOIN part ON p_partkey = song_id GROUP BY 1, 2), tot AS (SELECT user_id, sum(n) AS total FROM n GROUP BY 1), g AS (SELECT DISTINCT lower(p_type) AS genre FROM part)
      SELECT user_id, genre, round(0.6 * coalesce(n, 0) / total + 0.4 / (SELECT count(*) FROM g), 6) AS preference FROM (SELECT * FROM tot, g) LEFT JOIN n USING (user_id, genre)""",
    "sample_without_replacement": f"""WITH {CATALOG}, n AS (SELECT creator AS user_id, genre, count(*) AS n FROM cat GROUP BY 1, 2), tot AS (SELECT user_id, sum(n) AS total FROM n GROUP BY 1), g AS (SELECT DISTINCT genre FROM cat),
      pref AS (SELECT user_id, genre, round(0.6 * coalesce(n, 0) / total + 0.4 / (SELECT count(*) FROM g), 6) AS preference FROM (SELECT * FROM tot, g) LEFT JOIN n USING (user_id, genre)),
      k AS (SELECT user_id, song_id, round(-ln(greatest({uniform('42', 'user_id', 'song_id')}, 1e-10)) / ((play_count + 0.5) * (1 + 2 * preference)), 6) AS key FROM cat JOIN pref USING (genre))
      SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY key, song_id) AS draw FROM k QUALIFY draw <= 10""",
    "item_classes": f"""WITH o AS (SELECT p_partkey AS song_id, row_number() OVER (ORDER BY {uniform('42', 'p_partkey')}, p_partkey) AS i, count(*) OVER () AS n FROM part)
      SELECT song_id, CASE WHEN i <= floor(n * 0.05) THEN 'cold' WHEN i <= floor(n * 0.05) + floor(n * 0.15) THEN 'single' ELSE 'multi' END AS class FROM o""",
    "uniform_negatives": f"""WITH {LIKES}, songs AS (SELECT p_partkey AS song_id, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), u AS (SELECT DISTINCT user_id FROM likes),
      drawn AS (SELECT user_id, floor({uniform('42', 'user_id', 'd')} * (SELECT count(*) FROM part))::BIGINT AS i, min(d) AS d FROM u, range(0, 80) AS r(d) GROUP BY 1, 2),
      o AS (SELECT u.user_id, s.song_id, coalesce(d.d, 80 + {uniform('42', 'u.user_id', 's.song_id')}) AS o FROM u CROSS JOIN songs s LEFT JOIN drawn d ON d.user_id = u.user_id AND d.i = s.i)
      SELECT user_id, song_id, 0 AS label FROM o ANTI JOIN likes USING (user_id, song_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY o, song_id) <= 20""",
    "impression_negatives": f"WITH {HISTORY}, {SHOWN}, {NEGATIVES} SELECT user_id, song_id, 0 AS label FROM neg",
    "hard_negatives": f"""WITH {HISTORY}, {VECTORS}, {MEANS}, {SHOWN}, s AS (SELECT user_id, song_id, round(list_dot_product(m, v), 6) AS sim FROM shown JOIN umeans USING (user_id) JOIN unit USING (song_id)),
      near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, song_id) <= greatest(1, floor(count(*) OVER (PARTITION BY user_id) * 0.2)))
      SELECT user_id, song_id, sim FROM near QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {uniform('42/hard', 'user_id', 'song_id')}, song_id) <= 5""",
    "train_val_split": f"SELECT event_id, user_id, CASE WHEN row_number() OVER (ORDER BY {uniform('42/split', 'event_id')}, event_id) <= floor(count(*) OVER () * 0.2) THEN 'valid' ELSE 'train' END AS part FROM events",
    "infonce_loss": f"WITH {EXAMPLES}, n AS (SELECT user_id, sum(exp(score / 0.1)) AS others FROM ex WHERE label = 0 GROUP BY 1) SELECT user_id, song_id, round(-ln(exp(score / 0.1) / (exp(score / 0.1) + others)), 6) AS loss FROM ex JOIN n USING (user_id) WHERE label = 1",
    "bpr_loss": f"WITH {EXAMPLES} SELECT p.user_id, p.song_id, round(avg(ln(1 + exp(n.score - p.score))), 6) AS loss FROM ex p JOIN ex n ON n.user_id = p.user_id AND n.label = 0 WHERE p.label = 1 GROUP BY 1, 2",
    "tower_training_set": f"""WITH {HISTORY}, {SHOWN}, {NEGATIVES}, r AS (SELECT user_id, array_to_string(list(song_id ORDER BY seq), ',') AS recent FROM (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 8) GROUP BY 1),
      n AS (SELECT user_id, array_to_string(list(song_id ORDER BY song_id), ',') AS negatives FROM neg GROUP BY 1) SELECT user_id, song_id, recent, negatives FROM hist JOIN r USING (user_id) JOIN n USING (user_id)""",
    "precision_recall_ndcg_map": f"WITH {METRICS} SELECT user_id, k, precision, recall, ndcg, map FROM metrics",
    "metrics_over_cases": f"WITH {METRICS} SELECT k, count(*) AS cases, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("precision", "recall", "ndcg", "map")) + " FROM metrics GROUP BY 1",
    "diversity": f"WITH {SPLIT_DATE}, f AS (SELECT user_id, song_id, unnest(string_split(p_name, ' ')) AS x FROM lists JOIN part ON p_partkey = song_id WHERE rank <= 10) SELECT user_id, CASE WHEN count(DISTINCT song_id) <= 1 THEN 1.0 ELSE round(count(DISTINCT x) / count(x), 6) END AS diversity FROM f GROUP BY 1",
    "coverage": f"WITH {SPLIT_DATE} SELECT count(DISTINCT song_id) AS found, (SELECT count(*) FROM part) AS songs, round(count(DISTINCT song_id) / (SELECT count(*) FROM part), 6) AS coverage FROM lists WHERE rank <= 10",
    "distribution_stats": f"WITH {COUNTS} SELECT count(*) AS size, min(n) AS lowest, max(n) AS highest, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(stddev_pop(n), 6) AS std, " + ", ".join(f"round(quantile_cont(n, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 95, 99)) + " FROM users",
    "interaction_buckets": f"""WITH {COUNTS} SELECT * FROM (SELECT count(*) FILTER (n = 0) AS items_0, count(*) FILTER (n = 1) AS items_1, count(*) FILTER (n >= 2) AS items_2_up, count(*) FILTER (n >= 3) AS items_3_up, count(*) FILTER (n >= 5) AS items_5_up, count(*) FILTER (n >= 10) AS items_10_up FROM items),
      (SELECT count(*) FILTER (n = 0) AS users_0, count(*) FILTER (n BETWEEN 1 AND 5) AS users_1_5, count(*) FILTER (n BETWEEN 6 AND 10) AS users_6_10, count(*) FILTER (n BETWEEN 11 AND 20) AS users_11_20, count(*) FILTER (n BETWEEN 21 AND 50) AS users_21_50, count(*) FILTER (n >= 50) AS users_50_up FROM users)""",
    "popularity_concentration": f"WITH {COUNTS}, o AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i, count(*) OVER () AS c FROM items) SELECT round(sum(n) FILTER (i <= floor(c * 0.1)) / sum(n), 6) AS top_10, round(sum(n) FILTER (i <= floor(c * 0.01)) / sum(n), 6) AS top_1 FROM o",
    "interaction_sparsity": f"WITH {LIKES}, s AS (SELECT count(*) AS interactions, count(DISTINCT user_id) AS users, (SELECT count(*) FROM part) AS items FROM likes) SELECT *, round(1 - interactions / (users * items), 6) AS sparsity, round(interactions / users, 6) AS per_user, round(interactions / items, 6) AS per_item FROM s",
    "cf_viability": f"""WITH {COUNTS}, p AS (SELECT count(*) AS shared FROM likes a JOIN likes b ON a.song_id = b.song_id AND a.user_id < b.user_id), o AS (SELECT count(DISTINCT a.user_id) AS users_overlapping FROM likes a JOIN likes b ON a.song_id = b.song_id AND a.user_id <> b.user_id), u AS (SELECT count(*) AS users FROM users)
      SELECT *, round(shared / (users * (users - 1) / 2), 6) AS mean_overlap FROM (SELECT count(*) FILTER (n >= 2) AS items_2_up, count(*) FILTER (n >= 3) AS items_3_up, count(*) FILTER (n >= 5) AS items_5_up FROM items), p, o, u""",
    "top_users_items": f"WITH {COUNTS} SELECT * FROM (SELECT 'user' AS kind, user_id AS id, n FROM users ORDER BY n DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'song' AS kind, song_id AS id, n FROM items ORDER BY n DESC, id LIMIT 10)",
    "distributions_compared": f"""WITH {COUNTS}, {HISTORY}, own AS (SELECT p_partkey AS song_id, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT song_id, count(DISTINCT user_id) AS n FROM hist GROUP BY 1) ON song_id = p_partkey),
      a AS (SELECT count(*) AS items_a, round(avg(n), 6) AS mean_a, round(count(*) FILTER (n = 0) / count(*), 6) AS cold_a, round(count(*) FILTER (n = 1) / count(*), 6) AS single_a, round(count(*) FILTER (n > 1) / count(*), 6) AS multi_a FROM own),
      b AS (SELECT count(*) AS items_b, round(avg(n), 6) AS mean_b, round(count(*) FILTER (n = 0) / count(*), 6) AS cold_b, round(count(*) FILTER (n = 1) / count(*), 6) AS single_b, round(count(*) FILTER (n > 1) / count(*), 6) AS multi_b FROM items) SELECT *, round(mean_b / mean_a, 6) AS ratio FROM a, b""",
}
