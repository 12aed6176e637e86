"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

_SESSION = r"regexp_replace(lower(session_id), '^\s+|\s+$', '', 'g')"

P1_RUNS = rf"""
WITH e AS (
  SELECT DISTINCT segment_id, {_SESSION} AS session_id, label, start_frame, end_frame FROM maneuver_segments
  WHERE label IN (1, 2, 3) AND session_id IS NOT NULL AND segment_id IS NOT NULL AND end_frame > start_frame),
o AS (SELECT *, lag(label) OVER w AS before FROM e WINDOW w AS (PARTITION BY session_id ORDER BY start_frame, end_frame, segment_id, label)),
s AS (SELECT *, sum(CASE WHEN label = before THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY start_frame, end_frame, segment_id, label) AS stretch FROM o),
r AS (SELECT *, max(end_frame) OVER (PARTITION BY session_id, stretch ORDER BY start_frame, end_frame, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
b AS (SELECT *, sum(CASE WHEN start_frame <= reach + 6 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, stretch ORDER BY start_frame, end_frame, segment_id) AS run FROM r)
SELECT session_id, label, CAST(min(start_frame) AS INTEGER) AS start_frame, CAST(max(end_frame) AS INTEGER) AS end_frame,
       count(*) AS n_events, CAST(max(end_frame) - min(start_frame) AS BIGINT) AS duration
FROM b GROUP BY session_id, label, stretch, run"""

P1_FOUND = f"SELECT DISTINCT session_id, label, start_frame, end_frame FROM ({P1_RUNS}) WHERE n_events >= 2"

P2_FOUND = r"""
WITH RECURSIVE w AS (
  SELECT video1_id AS a, video2_id AS b,
         trim(regexp_replace(regexp_replace(lower(relationship), '[&+]', ' and ', 'g'), '[\s_-]+', ' ', 'g')) AS word
  FROM relationships),
l AS (SELECT DISTINCT a, b FROM w WHERE word IN ('copy', 'event', 'copy and event', 'reasoning') AND a <> b
      AND a IN (SELECT video_id FROM videos) AND b IN (SELECT video_id FROM videos)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
cc(id, g) USING KEY (id) AS (
  SELECT a, least(a, min(b)) FROM e GROUP BY a
  UNION
  SELECT e.a, min(cc.g) FROM cc JOIN e ON e.b = cc.id JOIN recurring.cc AS r ON r.id = e.a WHERE cc.g < r.g GROUP BY e.a)
SELECT id AS video_id, g AS group_id FROM cc"""

P2_GROUPS = f"""
WITH f AS ({P2_FOUND}) SELECT DISTINCT v.video_id, coalesce(f.group_id, v.video_id) AS group_id
FROM videos v LEFT JOIN f ON f.video_id = v.video_id WHERE v.video_id IS NOT NULL"""

P3_RANKED = """
WITH c AS (
  SELECT query_indices, cand_id, bot_similarity, CASE WHEN isfinite(dtw_distance) THEN dtw_distance END AS dtw_distance FROM scores
  WHERE bot_similarity IS NOT NULL AND isfinite(bot_similarity) AND query_indices <> cand_id),
d AS (SELECT *, row_number() OVER (PARTITION BY query_indices, cand_id ORDER BY bot_similarity DESC, dtw_distance ASC NULLS LAST) AS k FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_indices ORDER BY bot_similarity DESC, dtw_distance ASC NULLS LAST, cand_id) AS position FROM d WHERE k = 1)
SELECT query_indices, cand_id, bot_similarity, dtw_distance, CAST(position AS INTEGER) AS position FROM r WHERE position <= 10"""

P3_FOUND = f"SELECT query_indices, cand_id FROM ({P3_RANKED})"

_KEY = "[0-9]{8}_s[0-9]+_[a-z]+_[a-z]+"
P4_KEYS = rf"""
SELECT segment_id, person_session, coalesce(
  nullif(regexp_extract(sequence_name, '^({_KEY})_act[0-9]+_[a-z0-9]+$', 1), ''),
  nullif(regexp_extract(video_path, '(?:^|/)({_KEY})_act[0-9]+_[a-z0-9]+/', 1), ''),
  nullif(regexp_extract(regexp_replace(regexp_replace(lower(person_session), '^\s+|\s+$', '', 'g'), '[\s_-]+', '_', 'g'), '^({_KEY})$', 1), '')) AS session_key
FROM activity_segments"""

P4_FOUND = f"SELECT DISTINCT segment_id, session_key FROM ({P4_KEYS}) WHERE session_key IS NOT NULL AND person_session IS DISTINCT FROM session_key"




def _parts(entities: str, columns: str, own: str) -> str:
    """Rows of ``entities`` (with entity, also) with the part of their component: least member by recursion, then weighted rendezvous."""
    return rf"""
WITH RECURSIVE x AS ({entities}),
e AS (SELECT DISTINCT entity AS a, also AS b FROM x WHERE entity <> also UNION SELECT DISTINCT also, entity FROM x WHERE entity <> also),
cc(id, g) USING KEY (id) AS (
  SELECT a, least(a, min(b)) FROM e GROUP BY a
  UNION
  SELECT e.a, min(cc.g) FROM cc JOIN e ON e.b = cc.id JOIN recurring.cc AS r ON r.id = e.a WHERE cc.g < r.g GROUP BY e.a),
k AS (SELECT x.*, coalesce(cc.g, entity, also, chr(1) || 'alone' || chr(1) || coalesce(CAST({own} AS VARCHAR), chr(2))) AS component
      FROM x LEFT JOIN cc ON cc.id = coalesce(entity, also)),
s AS (SELECT component, arg_max(partition_name, -proportion / ln((CAST('0x' || substr(md5('0|' || partition_name || '|' || component), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) AS part
      FROM (SELECT DISTINCT component FROM k), (SELECT DISTINCT partition_name, proportion FROM partition_targets WHERE proportion > 0 AND partition_name IS NOT NULL) GROUP BY component)
SELECT DISTINCT {columns}, part FROM k JOIN s USING (component)"""


P4_ACTIVITY = _parts(
    rf"""SELECT segment_id, person_session, session_key, coalesce(session_key, '?' || lower(trim(person_session, ' '))) AS entity,
  coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(lower(person_session), '^\s+|\s+$', '', 'g'), '[\s_-]+', '_', 'g'), '^({_KEY})$', 1), ''), entity) AS also FROM ({P4_KEYS})""",
    "segment_id, person_session, session_key",
    "segment_id",
)
P4_MANEUVER = _parts(f"SELECT segment_id, {_SESSION} AS session_id, session_id AS entity, CAST(NULL AS VARCHAR) AS also FROM (SELECT segment_id, {_SESSION} AS session_id FROM maneuver_segments)", "segment_id, session_id", "segment_id")
P4_CLUSTERS = _parts(
    """SELECT query_indices, cand_id, cluster_id, 'c' || cluster_id AS entity, 'q' || query_indices AS also FROM (
    SELECT CAST(NULL AS BIGINT) AS query_indices, CAST(NULL AS BIGINT) AS cand_id, cluster_id FROM loco_folds
    UNION ALL SELECT query_indices, cand_id, CASE WHEN query_clusters >= 0 THEN query_clusters END FROM scores)""",
    "query_indices, cand_id, cluster_id",
    "cand_id",
)
P4_SHARES = f"""
WITH p AS (SELECT 'activity' AS dataset, part FROM ({P4_ACTIVITY}) UNION ALL SELECT 'maneuver', part FROM ({P4_MANEUVER}) UNION ALL SELECT 'clusters', part FROM ({P4_CLUSTERS})),
t AS (SELECT DISTINCT partition_name AS part, proportion FROM partition_targets WHERE partition_name IS NOT NULL AND proportion IS NOT NULL),
n AS (SELECT d.dataset, t.part, t.proportion, (SELECT count(*) FROM p WHERE p.dataset = d.dataset AND p.part = t.part) AS n
      FROM t, (SELECT unnest(['activity', 'maneuver', 'clusters']) AS dataset) d)
SELECT dataset, part, round(proportion, 6) AS target_share, n, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END, 6) AS actual_share
FROM n WINDOW w AS (PARTITION BY dataset)"""

# a source has one shard below twice SHARD_DOCUMENTS documents; beyond, this SQL doesn't hold
P7_CHAR_SHARES = r"""
WITH g AS (SELECT source, max(greatest(target_share, 0)) AS target_share, max(max_repeats) AS cap FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
d AS (SELECT doc_id, min({'source': source, 'n': n}) AS row FROM (
        SELECT doc_id, regexp_replace(regexp_replace(lower(source), '^\s+|\s+$', '', 'g'), '[\s_-]+', '_', 'g') AS source, length(text) AS n FROM documents)
      WHERE n > 0 AND source IN (SELECT source FROM g) GROUP BY doc_id),
c AS (SELECT doc_id, row.source AS source, row.n AS n FROM d),
h AS (SELECT g.source, g.target_share, g.cap, coalesce(sum(c.n), 0) AS have FROM g LEFT JOIN c ON c.source = g.source GROUP BY ALL),
s AS (SELECT *, CASE WHEN cap > 0 AND have > 0 THEN target_share ELSE 0.0 END AS share FROM h),
r AS (SELECT *, CASE WHEN share > 0 THEN have * cap * (SELECT sum(share) FROM (SELECT share FROM s ORDER BY source)) / share END AS reach FROM s),
b AS (SELECT CAST(floor(greatest(min(reach), 256) / 256) AS BIGINT) AS blocks, arg_min(source, {'reach': reach, 'source': source}) AS limiting FROM r),
q AS (SELECT source, share / (2 * k + 1) AS quotient FROM (SELECT source, share, unnest(range(0, least(CAST(ceil(have * cap / 256) AS BIGINT), (SELECT blocks FROM b)))) AS k FROM r WHERE share > 0)),
a AS (SELECT source, count(*) AS given FROM (SELECT source FROM q ORDER BY quotient DESC, source LIMIT (SELECT blocks FROM b)) GROUP BY source),
w AS (SELECT r.*, least(coalesce(given, 0) * 256, have * cap) AS wanted FROM r LEFT JOIN a USING (source)),
o AS (SELECT c.*, coalesce(sum(n) OVER (PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
t AS (SELECT o.source, o.n, least(wanted // have + CASE WHEN wanted % have > 0 AND before + n / 2 <= wanted % have THEN 1 ELSE 0 END, cap) AS times FROM o JOIN w USING (source)),
k AS (SELECT source, count(*) AS n_documents, sum(n * times) AS taken FROM t WHERE times > 0 GROUP BY source)
SELECT w.source, w.target_share, w.cap AS max_repeats, CAST(w.have AS BIGINT) AS tokens_available, w.source = (SELECT limiting FROM b) AS limiting,
       coalesce(n_documents, 0) AS n_documents, CAST(coalesce(taken, 0) AS BIGINT) AS tokens_taken,
       CASE WHEN sum(taken) OVER () > 0 THEN coalesce(taken, 0) / sum(taken) OVER () ELSE 0.0 END AS actual_share
FROM w LEFT JOIN k USING (source)"""


def oracle_sql() -> dict[str, str]:
    return {"p2_groups": P2_GROUPS, "p4_activity": P4_ACTIVITY, "p4_maneuver": P4_MANEUVER, "p4_clusters": P4_CLUSTERS, "p4_shares": P4_SHARES, "p7_char_shares": P7_CHAR_SHARES, "p1_found": P1_FOUND, "p1_runs": P1_RUNS, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_ranked": P3_RANKED, "p4_found": P4_FOUND}
