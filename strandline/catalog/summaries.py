"""Reports, correlations, bootstrap intervals, classifiers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.catalog.base import EVENTS, ITEMS, items, r6, user_events
from strandline.catalog.rankings import RANK_METRICS_EXACT, WITH, pair_scores, relevant_ranks
from strandline.functions import parse
from strandline.operators import learn as L
from strandline.operators import metrics as M
from strandline.operators import reports as R
from strandline.operators import resample as B
from strandline.scratch import shared_root
from strandline.streaming import streams as Z
from strandline.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TYPES = ("copy", "event", "copy and event", "reasoning")


def _related(s, d):
    r = table(s, d, "relationships").where("video1_id is not null and video2_id is not null").select("video1_id", "video2_id", "relationship").distinct()
    return r.withColumn("score", F.round(F.sin(F.col("video1_id") * 1.0 + F.col("video2_id")), 6))


QUERIES["relationship_buckets"] = lambda s, d: M.separation(R.relationship_buckets(_related(s, d), "relationship", "independent", TYPES), ["bucket"], "score", "label").select("bucket", "n_pos", "n_neg", r6("gap").alias("gap"))
SQL["relationship_buckets"] = """WITH r AS (SELECT DISTINCT video1_id, video2_id, relationship FROM relationships WHERE video1_id IS NOT NULL AND video2_id IS NOT NULL), s AS (SELECT relationship, round(sin(video1_id * 1.0::DOUBLE + video2_id), 6) AS score FROM r WHERE relationship IN ('independent', 'copy', 'event', 'copy and event', 'reasoning')),
b AS (SELECT CASE WHEN relationship = 'independent' THEN t ELSE relationship END AS bucket, score, CAST(relationship <> 'independent' AS INTEGER) AS label FROM s CROSS JOIN (VALUES ('copy'), ('event'), ('copy and event'), ('reasoning')) AS ts(t) WHERE relationship = 'independent' OR relationship = t
  UNION ALL SELECT '_all', score, CAST(relationship <> 'independent' AS INTEGER) FROM s)
SELECT bucket, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, round(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0), 6) + 0.0 AS gap FROM b GROUP BY bucket"""


def _answers(s, d):
    e = user_events(s, d)
    text = F.when(F.col("k") < 30, "I think forward, not REVERSE").when(F.col("k") < 60, "reverse.").when(F.col("k") < 80, "it is Intact").otherwise("cannot say; tampered?")
    return e.select(F.col("user_id").alias("clip_id"), (F.col("event_id") % 3).alias("prompt_id"), F.when(F.col("event_id") % 2 == 0, "forward").otherwise("reverse").alias("condition"), text.alias("response"))


ANS = f"""WITH {EVENTS}, an AS (SELECT user_id AS clip_id, event_id % 3 AS prompt_id, CASE WHEN event_id % 2 = 0 THEN 'forward' ELSE 'reverse' END AS condition,
CASE WHEN k < 30 THEN 'FORWARD' WHEN k < 60 THEN 'REVERSE' END AS dir, CASE WHEN k >= 80 THEN 'TAMPERED' WHEN k >= 60 THEN 'INTACT' END AS itg FROM ev)"""
QUERIES["balanced_accuracy"] = lambda s, d: R.balanced_accuracy(_answers(s, d).withColumn("a", parse.direction_answer(F.col("response"))), "prompt_id", "condition", "a").select("prompt_id", *(r6(c).alias(c) for c in ("fwd_acc", "rev_acc", "balanced")))
SQL["balanced_accuracy"] = f"""{ANS}, p AS (SELECT prompt_id, count(*) FILTER (condition = 'forward' AND dir = 'FORWARD') / CAST(greatest(count(*) FILTER (condition = 'forward' AND dir IS NOT NULL), 1) AS DOUBLE) AS f,
count(*) FILTER (condition = 'reverse' AND dir = 'REVERSE') / CAST(greatest(count(*) FILTER (condition = 'reverse' AND dir IS NOT NULL), 1) AS DOUBLE) AS r FROM an GROUP BY prompt_id)
SELECT prompt_id, round(f, 6) + 0.0 AS fwd_acc, round(r, 6) + 0.0 AS rev_acc, round((f + r) / 2, 6) + 0.0 AS balanced FROM p"""
QUERIES["integrity_consistency"] = lambda s, d: R.integrity_consistency(_answers(s, d).withColumn("a", parse.integrity_answer(F.col("response"))), "clip_id", "condition", "a").select("condition", r6("acc").alias("acc"))
SQL["integrity_consistency"] = f"""{ANS}, x AS (SELECT *, CASE WHEN itg IS NOT NULL THEN CAST(itg = CASE WHEN condition = 'forward' THEN 'INTACT' ELSE 'TAMPERED' END AS INTEGER) END AS ok FROM an)
SELECT condition, round(coalesce(sum(ok), 0) / CAST(greatest(count(ok), 1) AS DOUBLE), 6) + 0.0 AS acc FROM x GROUP BY condition
UNION ALL SELECT 'consistency', round(avg(m), 6) + 0.0 FROM (SELECT clip_id, min(coalesce(ok, 1)) AS m FROM x GROUP BY clip_id)"""
QUERIES["text_only_bias"] = lambda s, d: R.share_of(_answers(s, d).withColumn("a", parse.direction_answer(F.col("response"))), "a", "FORWARD").select(r6("share").alias("share"))
SQL["text_only_bias"] = f"{ANS} SELECT round(count(*) FILTER (dir = 'FORWARD') / CAST(count(dir) AS DOUBLE), 6) + 0.0 AS share FROM an"
QUERIES["topk_participants"] = lambda s, d: R.top_groups(user_events(s, d), "user_id", 10)
SQL["topk_participants"] = "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"
_named = lambda s, d: user_events(s, d).select("user_id", (F.col("k") + F.col("user_id") % 5 * 100).alias("video"))
QUERIES["manifest_stats"] = lambda s, d: R.cumulative_distinct(_named(s, d), "user_id", "video").where("place <= 10")
SQL["manifest_stats"] = f"""WITH {EVENTS}, x AS (SELECT user_id, k + user_id % 5 * 100 AS video FROM ev), g AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS place FROM x GROUP BY user_id),
f AS (SELECT video, min(place) AS place FROM x JOIN g USING (user_id) GROUP BY video), c AS (SELECT place, count(*) AS fresh FROM f GROUP BY place)
SELECT * FROM (SELECT CAST(g.place AS INTEGER) AS place, user_id, CAST(sum(n) OVER (ORDER BY g.place) AS BIGINT) AS n_so_far, CAST(sum(coalesce(fresh, 0)) OVER (ORDER BY g.place) AS BIGINT) AS items_so_far FROM g LEFT JOIN c ON c.place = g.place) WHERE place <= 10"""
QUERIES["manifest_durations"] = lambda s, d: R.duration_bins(user_events(s, d), "value", [6, 8, 10, 12, 15])
SQL["manifest_durations"] = "SELECT CAST(b AS INTEGER) AS bin, (SELECT count(*) FROM events WHERE value >= lo AND value < hi) AS n FROM (VALUES (0, 6, 8), (1, 8, 10), (2, 10, 12), (3, 12, 15)) AS t(b, lo, hi)"
QUERIES["completeness_verify"] = lambda s, d: R.completeness(user_events(s, d).select(F.concat_ws("_", "event_type", F.col("k").cast("string")).alias("vid")), user_events(s, d).where("value > 150").select(F.concat_ws("_", "event_type", F.col("k").cast("string")).alias("vid")), "vid")
SQL["completeness_verify"] = f"WITH {EVENTS}, n AS (SELECT event_type, k, max(value) > 150 AS have FROM ev GROUP BY event_type, k) SELECT event_type AS prefix, count(*) FILTER (NOT have) AS n_missing, count(*) FILTER (have) AS n_present FROM n GROUP BY event_type"
QUERIES["fold_curve_mean"] = lambda s, d: R.fold_curve(table(s, d, "loco_folds"), "training_map_by_alpha", 21).select(F.round("alpha", 2).alias("alpha"), r6("mean").alias("mean"))
SQL["fold_curve_mean"] = "SELECT round((i - 1) / 20.0, 2) AS alpha, round(avg(v), 6) + 0.0 AS mean FROM (SELECT generate_subscripts(training_map_by_alpha, 1) AS i, unnest(training_map_by_alpha) AS v FROM loco_folds) GROUP BY i"
QUERIES["eta_projection"] = lambda s, d: user_events(s, d).groupBy("event_type").agg(r6(F.avg("value") * 1000 / 3600).alias("hours"))
SQL["eta_projection"] = "SELECT event_type, round(avg(value) * 1000 / 3600, 6) + 0.0 AS hours FROM events GROUP BY event_type"
QUERIES["clip_stats_median"] = lambda s, d: user_events(s, d).groupBy("event_type").agg(F.median("value").alias("median_value"), F.median("k").alias("median_k"), r6(F.avg("value")).alias("mean_value"))
SQL["clip_stats_median"] = f"WITH {EVENTS} SELECT event_type, median(value) AS median_value, CAST(median(k) AS DOUBLE) AS median_k, round(avg(value), 6) + 0.0 AS mean_value FROM ev GROUP BY event_type"
QUERIES["corr_pearson"] = lambda s, d: R.pearson(user_events(s, d), "value", "k").select(r6("r").alias("r"))
SQL["corr_pearson"] = f"WITH {EVENTS} SELECT round(corr(value, k), 6) + 0.0 AS r FROM ev"
QUERIES["corr_spearman"] = lambda s, d: R.spearman(user_events(s, d), ["event_type"], "value", "k").select("event_type", r6("r").alias("r"))
SQL["corr_spearman"] = f"""WITH {EVENTS}, r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS b FROM ev)
SELECT event_type, round(corr(a, b), 6) + 0.0 AS r FROM r GROUP BY event_type"""
QUERIES["session_stats"] = lambda s, d: R.session_stats(user_events(s, d).withColumn("session", F.concat(F.lit("u"), F.col("user_id").cast("string"))), "session", "event_type", ["click", "view"], "value").withColumn("duration", F.round("duration", 2))
SQL["session_stats"] = "SELECT coalesce('u' || user_id, 'TOTAL') AS session, round(sum(value), 2) AS duration, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY ROLLUP (user_id)"
QUERIES["context_sweep"] = lambda s, d: M.average_precision(pair_scores(s, d).withColumn("width", F.explode(F.array(*(F.lit(x) for x in (1.0, 2.0, 4.0))))).withColumn("score", F.round(F.col("sim") - F.col("dist") / F.col("width"), 6)), ["width"], "score", "gt").select("width", r6("ap").alias("ap"))
SQL["context_sweep"] = f"""{WITH}, o AS (SELECT width, gt, round(sim - dist / width, 6) AS s FROM ps CROSS JOIN (SELECT unnest([1.0::DOUBLE, 2.0, 4.0]) AS width)), c AS (SELECT width, s, sum(gt) AS pos, count(*) AS n FROM o GROUP BY width, s),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY width ORDER BY s DESC)) SELECT width, round(sum(pos * tp / CAST(seen AS DOUBLE)) / sum(pos), 6) + 0.0 AS ap FROM t GROUP BY width"""
QUERIES["window_features"] = lambda s, d: user_events(s, d).select("user_id", "event_id", F.expr("row_number() over (partition by user_id order by value desc, event_id)").alias("rn"), F.expr("lag(value) over (partition by user_id order by event_id)").alias("before"), F.expr("lead(value) over (partition by user_id order by event_id)").alias("after"), F.expr("dense_rank() over (partition by user_id order by event_type)").alias("dr"))
SQL["window_features"] = "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rn, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS after, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS INTEGER) AS dr FROM events"
QUERIES["set_intersect"] = lambda s, d: user_events(s, d).where("event_type = 'click'").select("user_id", "k").intersect(user_events(s, d).where("event_type = 'view'").select("user_id", "k"))
SQL["set_intersect"] = f"WITH {EVENTS} SELECT user_id, k FROM ev WHERE event_type = 'click' INTERSECT SELECT user_id, k FROM ev WHERE event_type = 'view'"
QUERIES["set_except"] = lambda s, d: user_events(s, d).where("event_type = 'click'").select("user_id", "k").exceptAll(user_events(s, d).where("event_type = 'view'").select("user_id", "k"))
SQL["set_except"] = f"WITH {EVENTS} SELECT user_id, k FROM ev WHERE event_type = 'click' EXCEPT ALL SELECT user_id, k FROM ev WHERE event_type = 'view'"

# resampling: draws by md5, so SQL can repeat them


def _per_query(s, d):
    m = M.metrics_of_ranks(relevant_ranks(s, d), ["query_id"], "rank").select("query_id", "ap", "rr")
    return m.join(items(s, d).select(F.col("item").alias("query_id"), "cluster"), "query_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_methods = lambda s, d: pair_scores(s, d).withColumn("near", -F.col("dist"))
QUERIES["boot_mean"] = lambda s, d: _rounded(B.cluster_mean(_per_query(s, d), "query_id", "ap", draws="md5"))
QUERIES["boot_cluster_mean"] = lambda s, d: _rounded(B.cluster_mean(_per_query(s, d), "cluster", "ap", draws="md5"))
QUERIES["boot_paired_mean_diff"] = lambda s, d: _rounded(B.paired_mean_difference(_per_query(s, d), "cluster", "ap", "rr", draws="md5"))
_MEANS = f"""WITH m AS ({RANK_METRICS_EXACT}), x AS (SELECT m.query_id, vec.label AS cluster, ap, rr FROM m JOIN embeddings vec ON vec.vec_id = m.query_id)"""


def _boot_sql(cluster: str, value: str, name: str = "") -> str:
    """CTEs of the resampled mean: one row of point, ci_low, ci_high, n_clusters in b{name}."""
    return f"""c{name} AS (SELECT row_number() OVER (ORDER BY {cluster}) - 1 AS place, sum({value}) AS s, count(*) AS n FROM x GROUP BY {cluster}),
d{name} AS (SELECT r, ('0x' || substr(md5('42|' || r || '|' || (i // 4)), 1 + 8 * (i % 4), 8))::BIGINT % k AS place
  FROM (SELECT k, unnest(range(0, k)) AS i FROM (SELECT count(*) AS k FROM c{name})), (SELECT unnest(range(0, 2000)) AS r)),
w{name} AS (SELECT r, sum(s) / sum(n) AS v FROM d{name} JOIN c{name} USING (place) GROUP BY r),
b{name} AS (SELECT (SELECT sum(s) / sum(n) FROM c{name}) AS point, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, (SELECT count(*) FROM c{name}) AS n_clusters FROM w{name})"""


_ROUNDED = "SELECT round(point, 6) + 0.0 AS {point}, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, n_clusters FROM b"
SQL["boot_mean"] = f"{_MEANS}, {_boot_sql('query_id', 'ap')} {_ROUNDED.format(point='point')}"
SQL["boot_cluster_mean"] = f"{_MEANS}, {_boot_sql('cluster', 'ap')} {_ROUNDED.format(point='point')}"
SQL["boot_paired_mean_diff"] = f"{_MEANS}, {_boot_sql('cluster', 'ap - rr')} {_ROUNDED.format(point='difference')}"


def _width(s, d):
    rows = _per_query(s, d)
    wide = B.cluster_mean(rows, "cluster", "ap", draws="md5").select((F.col("ci_high") - F.col("ci_low")).alias("w"))
    narrow = B.cluster_mean(rows, "query_id", "ap", draws="md5").select((F.col("ci_high") - F.col("ci_low")).alias("n"))
    return wide.join(narrow, F.lit(True)).select(F.round(B.width_ratio(F.col("w"), F.col("n")), 4).alias("ratio"))  # a row each


QUERIES["boot_width_ratio"] = _width
SQL["boot_width_ratio"] = f"{_MEANS}, {_boot_sql('cluster', 'ap', 'w')}, {_boot_sql('query_id', 'ap', 'n')} SELECT round((bw.ci_high - bw.ci_low) / greatest(bn.ci_high - bn.ci_low, 1e-9), 4) AS ratio FROM bw, bn"

# pooled curves of thousands of replicates, and fitted models: SQL is too slow or can't; compared with loops in tests

QUERIES["boot_ap_pairs"] = lambda s, d: B.pair_interval(pair_scores(s, d), "sim", "gt", "ap")
QUERIES["boot_auc_pairs"] = lambda s, d: B.pair_interval(pair_scores(s, d), "sim", "gt", "auc", 2000, seed=43)
QUERIES["boot_cluster_ap"] = lambda s, d: B.cluster_ap_interval(B.cluster_ap(_methods(s, d), "cluster", ["sim", "near"], "gt"))
QUERIES["boot_paired_ap_diff"] = lambda s, d: B.paired_ap_difference(B.cluster_ap(_methods(s, d), "cluster", ["sim", "near"], "gt"), "sim", "near")
_learnable = lambda s, d: _methods(s, d).select("item_a", "item_b", "cluster", F.col("gt").alias("y"), "sim", "near")
QUERIES["cv_stratified_logreg"] = lambda s, d: L.cross_validated(_learnable(s, d), ["sim", "near"], "y", ["item_a", "item_b"])
QUERIES["lodo_logreg"] = lambda s, d: L.leave_one_out(_learnable(s, d).withColumn("dataset", F.col("cluster") % 3), "dataset", ["sim", "near"], "y")


def _features(s, d):
    return items(s, d).select("item", "cluster", (F.col("kind") == 0).cast("int").alias("y"), *(F.element_at("v", k + 1).alias(f"f{k}") for k in range(8)))


# smaller than the operators' defaults, which take minutes here (README)
QUERIES["cv_group_probe"] = lambda s, d: L.group_probe(_features(s, d), "cluster", [f"f{k}" for k in range(8)], "y", cs=(0.1, 1.0), k=3)
QUERIES["cv_mlp_probe"] = lambda s, d: L.mlp_probe(_features(s, d), "cluster", [f"f{k}" for k in range(8)], "y", hidden=(16, 16), k=3, max_iter=30)

# streams over the events, run to the end


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "events").schema
    return Z.file_stream(s, f"{d}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _tumbling(s, d):
    out = Z.run_to_table(Z.tumbling_pool(_event_stream(s, d), "ts", ["event_type"], "value", "1 day", "40 days"), "tumbling", "complete")
    return out.select("event_type", F.unix_seconds("start").alias("start"), "n", r6("mean").alias("mean"), "max")


QUERIES["stream_tumbling_pool"] = _tumbling
SQL["stream_tumbling_pool"] = "SELECT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, max(value) AS max FROM events GROUP BY event_type, date_trunc('day', ts)"


def _sessions(s, d):
    out = Z.run_to_table(Z.session_segments(_event_stream(s, d), "ts", "user_id", "12 hours", "40 days"), "sessions", "complete")
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


QUERIES["stream_session_segments"] = _sessions
SQL["stream_session_segments"] = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM r GROUP BY user_id, run"""


def _runs(s, d):
    out = Z.run_to_table(Z.run_segments(_event_stream(s, d), "user_id", "event_id", "event_type", "ts", "1 hour"), "runs")
    return out.select(F.col("key").alias("user_id"), "label", "start", "last", "n")


QUERIES["stream_run_segments"] = _runs
# a key's last run is open until the watermark, an hour behind the newest event, is a day past the key's own newest
SQL["stream_run_segments"] = """WITH g AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM g),
k AS (SELECT user_id, max(run) AS last_run, epoch_ms(max(ts)) + 86400000 AS until FROM r GROUP BY user_id),
m AS (SELECT epoch_ms(max(ts)) - 3600000 AS watermark FROM events)
SELECT r.user_id, any_value(event_type) AS label, min(event_id) AS start, max(event_id) AS last, count(*) AS n
FROM r JOIN k USING (user_id) CROSS JOIN m WHERE run < last_run OR until < watermark GROUP BY r.user_id, run"""


def _stream_gallery(s, d):
    from strandline.operators.gallery import gallery_best

    it = items(s, d)
    path = f"{shared_root(s)}/strandline-gallery-{uuid.uuid4().hex}"
    queries = Z.file_stream(s, f"{d}/embeddings.parquet", table(s, d, "embeddings").schema).select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"))
    return Z.best_of_gallery(queries, it, path, lambda q, g: gallery_best(q, g, "item", "v", 3), 3)


QUERIES["stream_topk_gallery"] = _stream_gallery
SQL["stream_topk_gallery"] = f"""WITH {ITEMS}, g AS (SELECT a.item AS query_id, b.item AS cand_id, round(list_sum(list_transform(range(1, 65), lambda k: a.v[k] * b.v[k])), 6) AS sim FROM items a JOIN items b ON a.item <> b.item)
SELECT query_id, cand_id, CAST(place AS INTEGER) AS place FROM (SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cand_id) AS place FROM g) WHERE place <= 3"""
