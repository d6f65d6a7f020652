"""Queries of ordered rows: sessions, alignment, peaks, thinning, suppression, orders and samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..operators import fusion, joins
from ..operators import sequences as seq
from ..operators import vector
from ..sources import shared, views
from ..sources.views import with_views
from .registry import query
from .relational import hits, text_hits

_HITS = "frames queries hits"


@query(with_views(_HITS, """ SELECT query_id, video_id, frame_id, rank::INTEGER AS rank FROM (SELECT query_id, video_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM
  (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, video_id, timestamp_ms // 10000 ORDER BY score DESC, frame_id) = 1)) WHERE rank <= 20"""))
def rank_after_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Ranks counted over first hits only (one for each ten seconds of a video)."""
    h = hits(spark, d).withColumn("slot", F.expr("timestamp_ms div 10000"))
    first = fusion.first_per(h, ["query_id", "video_id", "slot"], [F.desc("score"), F.col("frame_id")]).drop("rank")
    return fusion.top_per(first, ["query_id"], [F.desc("score"), F.col("frame_id")], 20).select("query_id", "video_id", "frame_id", "rank")


@query(with_views("segments timeline", """, m AS (SELECT s.segment_id, s.video_id, (length(s.text) % 37) / 37.0::DOUBLE AS score, t.frame_id, abs(t.timestamp_ms - (s.start_ms + s.end_ms) // 2) AS distance, t.timestamp_ms, t.frame_idx,
  t.timestamp_ms >= s.start_ms AND t.timestamp_ms < s.end_ms AS inside FROM segments s JOIN timeline t USING (video_id)),
  p AS (SELECT * FROM m WHERE inside OR distance <= 4000 QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY NOT inside, distance, timestamp_ms, frame_idx, frame_id) = 1)
  SELECT frame_id, segment_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, frame_id)::INTEGER AS rank FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, segment_id) = 1) QUALIFY rank <= 50"""))
def best_segment_per_frame(spark: SparkSession, d: str) -> DataFrame:
    """Segments projected to frames, the best segment of each frame, ranked anew."""
    from ..operators.joins import nearest_frame

    s = views.segments(spark, d)
    score = s.select("segment_id", F.round((F.length("text") % 37) / 37.0, 6).alias("score"))
    near = nearest_frame(s, views.timeline(spark, d), 4000).join(score, "segment_id")
    best = fusion.first_per(near, ["frame_id"], [F.desc("score"), F.col("segment_id")]).orderBy(F.desc("score"), "frame_id").limit(50)
    return best.select("frame_id", "segment_id", "score", F.row_number().over(W.orderBy(F.desc("score"), "frame_id")).alias("rank"))


@query(with_views("timeline", """, g AS (SELECT *, coalesce((timestamp_ms - lag(timestamp_ms) OVER w > 3000)::INT, 0) AS new FROM timeline WINDOW w AS (PARTITION BY video_id ORDER BY timestamp_ms, frame_id))
  SELECT video_id, session, count(*) AS frames, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms FROM (SELECT *, (sum(new) OVER (PARTITION BY video_id ORDER BY timestamp_ms, frame_id))::BIGINT AS session FROM g) GROUP BY ALL"""))
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = seq.gap_sessions(views.timeline(spark, d), ["video_id"], "timestamp_ms", 3000, "frame_id")
    return s.groupBy("video_id", "session").agg(F.count("*").alias("frames"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"))


@query("WITH RECURSIVE " + views.SQL["timeline"] + """, o AS (SELECT video_id, timestamp_ms AS t, frame_idx AS i FROM timeline),
  r(video_id, i, t, start, cluster) AS (SELECT video_id, i, t, t, 0::BIGINT FROM o WHERE i = 0 UNION ALL SELECT o.video_id, o.i, o.t, CASE WHEN o.t - r.t > 4000 OR o.t - r.start > 9000 THEN o.t ELSE r.start END,
  r.cluster + (o.t - r.t > 4000 OR o.t - r.start > 9000)::BIGINT FROM r JOIN o ON o.video_id = r.video_id AND o.i = r.i + 1)
  SELECT video_id, cluster, count(*) AS frames, min(t) AS start_ms, max(t) AS end_ms FROM r GROUP BY ALL""")
def bounded_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end at a gap or at a longest span."""
    rows = views.timeline(spark, d).select("video_id", "timestamp_ms", "frame_id")
    c = seq.fold(rows, "video_id", ["timestamp_ms", "frame_id"], "cluster", "long", lambda p: seq.bounded_clusters(p["timestamp_ms"].to_numpy(), 4000, 9000))
    return c.groupBy("video_id", "cluster").agg(F.count("*").alias("frames"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"))


ALIGNED = with_views("frames queries tasks scored", """, f AS (SELECT task, event, video_id, min(rank) - 1 AS rank0 FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM scored QUALIFY rank <= 500) GROUP BY ALL),
  short AS (SELECT task, video_id FROM (SELECT task, video_id, count(*) AS coverage, round(sum(1.0::DOUBLE / (60 + rank0)), 9) AS votes FROM f GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY task ORDER BY coverage DESC, votes DESC, video_id) <= 200),
  w AS (SELECT task, video_id, frame_id, timestamp_ms, max(score) FILTER (WHERE event = 0) AS s0, max(score) FILTER (WHERE event = 1) AS s1, max(score) FILTER (WHERE event = 2) AS s2
    FROM scored JOIN short USING (task, video_id) GROUP BY ALL),
  a AS (SELECT *, s1 - 1e-5::DOUBLE * timestamp_ms + m.v AS v1 FROM (SELECT *, max({'v': s0 + 1e-5::DOUBLE * timestamp_ms, 't': timestamp_ms, 'f': frame_id}) OVER before AS m FROM w
    WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL
    WINDOW before AS (PARTITION BY task, video_id ORDER BY timestamp_ms, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
  z AS (SELECT *, s2 - 1e-5::DOUBLE * timestamp_ms + n.v AS v2 FROM (SELECT *, max({'v': v1 + 1e-5::DOUBLE * timestamp_ms, 't': timestamp_ms, 'f': frame_id, 'p': m.f}) FILTER (WHERE v1 IS NOT NULL) OVER before AS n FROM a
    WINDOW before AS (PARTITION BY task, video_id ORDER BY timestamp_ms, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
  paths AS (SELECT task, video_id, row_number() OVER (PARTITION BY task, video_id ORDER BY v2 DESC, timestamp_ms, frame_id) AS path_no, v2 AS score, n.p AS f0, n.f AS f1, frame_id AS f2 FROM z WHERE v2 IS NOT NULL),
  deep AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY path_no, score DESC, video_id) AS place FROM paths JOIN (SELECT task, ceil(100.0 / count(*)) AS depth FROM short GROUP BY task) USING (task)
    WHERE path_no <= depth QUALIFY place <= 100)""")


def aligned(spark: SparkSession, d: str, top_k: int = 500, max_videos: int = 200, paths: int = 100, delta: float = 0.0, power: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(shortlist, paths) of every task: the videos that its events' best frames vote for, and the best ordered choices of
    a frame for each event in each of them."""
    tasks = views.tasks(spark, d)
    found = hits(spark, d, top_k).join(tasks.select("query_id", "task", "event"), "query_id")
    short = shared.written(fusion.video_shortlist(found, "event", top=max_videos, by=("task",)).select("task", "video_id"), "shortlist")
    videos = tasks.select("query_id", "task").join(short, "task").select("query_id", "video_id")
    corpus = views.frames(spark, d).select("video_id", "frame_id", "timestamp_ms", "embedding")
    scored = vector.scored_within(tasks, corpus, videos)
    return short, seq.align_events(scored, ["task", "video_id"], 3, paths=paths, delta=delta, power=power)


@query(ALIGNED + " SELECT task, video_id, round(score, 6) AS score FROM paths WHERE path_no = 1")
def event_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The best choice of each shortlisted video."""
    return aligned(spark, d, paths=1)[1].select("task", "video_id", F.round("score", 6).alias("score"))


@query(ALIGNED + " SELECT task, video_id, path_no::INTEGER AS path_no, place::INTEGER AS place, round(score, 6) AS score, concat_ws(',', f0, f1, f2) AS frame_ids FROM deep")
def ordered_events(spark: SparkSession, d: str) -> DataFrame:
    """Three ordered events: shortlist, alignment, and a hundred paths of each task, one of a video before its second."""
    short, paths = aligned(spark, d)
    out = seq.diversified(paths, short, "task")
    frames = F.array_join(F.col("frame_ids").cast("array<string>"), ",")
    return out.select("task", "video_id", "path_no", "place", F.round("score", 6).alias("score"), frames.alias("frame_ids"))


@query()
def ordered_events_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The same where events must fall into different clusters of frames, and weak events weigh more."""
    short, paths = aligned(spark, d, delta=0.1, power=0.5)
    out = seq.diversified(paths, short, "task")
    frames = F.array_join(F.col("frame_ids").cast("array<string>"), ",")
    return out.select("task", "video_id", "path_no", "place", F.round("score", 6).alias("score"), frames.alias("frame_ids"))


@query(ALIGNED + " SELECT task, video_id::VARCHAR AS video_id, f0, f1, f2 FROM deep")
def ordered_events_csv(spark: SparkSession, d: str) -> DataFrame:
    """The submission files: a folder for each task, in it rows of a video and a frame for each event; written, and read
    again."""
    path = shared.shared_path(spark, "submission")
    short, paths = aligned(spark, d)
    rows = seq.diversified(paths, short, "task").repartition("task").sortWithinPartitions("task", "place")
    video = F.regexp_replace(F.col("video_id").cast("string"), r"\.mp4$", "").alias("video_id")
    rows.select("task", video, *[F.col("frame_ids")[i].alias(f"f{i}") for i in range(3)]).write.partitionBy("task").csv(path)
    got = spark.read.schema("video_id string, f0 long, f1 long, f2 long").option("recursiveFileLookup", True).csv(path)
    return got.withColumn("task", F.regexp_extract(F.col("_metadata.file_path"), "task=([0-9]+)/", 1).cast("long"))


CLUSTERS = with_views("frames queries tasks scored hits", """, t AS (SELECT DISTINCT task, video_id FROM hits JOIN tasks USING (query_id) WHERE rank <= 10),
  e AS (SELECT task, video_id, frame_id, timestamp_ms, max(score) FILTER (WHERE event = 0) AS a, max(score) FILTER (WHERE event = 1) AS b, max(score) FILTER (WHERE event = 2) AS c
    FROM scored JOIN t USING (task, video_id) GROUP BY ALL),
  v AS (SELECT *, row_number() OVER (PARTITION BY task, video_id ORDER BY timestamp_ms, frame_id) AS i FROM e WHERE a + b + c IS NOT NULL),
  r(task, video_id, frame_id, i, a, b, c, cluster) AS (SELECT task, video_id, frame_id, i, a, b, c, 0::BIGINT FROM v WHERE i = 1 UNION ALL
    SELECT task, video_id, frame_id, i, CASE WHEN far THEN a ELSE ra END, CASE WHEN far THEN b ELSE rb END, CASE WHEN far THEN c ELSE rc END, cluster + far::BIGINT FROM
    (SELECT v.*, r.a AS ra, r.b AS rb, r.c AS rc, r.cluster, greatest(abs(v.a - r.a), abs(v.b - r.b), abs(v.c - r.c)) > 0.15 AS far FROM r JOIN v ON v.task = r.task AND v.video_id = r.video_id AND v.i = r.i + 1))
  SELECT task, video_id, frame_id, cluster FROM r""").replace("WITH ", "WITH RECURSIVE ", 1)


@query(CLUSTERS)
def anchor_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Frames in order, a new cluster where a frame's event scores are over 0.15 from those of the cluster's first."""
    tasks = views.tasks(spark, d)
    videos = hits(spark, d, 10).join(tasks.select("query_id", "task"), "query_id").select("task", "video_id").distinct()
    corpus = views.frames(spark, d).select("video_id", "frame_id", "timestamp_ms", "embedding")
    scored = vector.scored_within(tasks, corpus, tasks.select("query_id", "task").join(videos, "task"))
    names = [f"s{e}" for e in range(3)]
    each = [F.max(F.when(F.col("event") == e, F.col("score"))).alias(n) for e, n in enumerate(names)]
    rows = scored.groupBy("task", "video_id", "frame_id", "timestamp_ms").agg(*each).dropna(subset=names)
    f = lambda p: seq.anchor_clusters(p[names].to_numpy(), 0.15)
    return seq.fold(rows, ["task", "video_id"], ["timestamp_ms", "frame_id"], "cluster", "long", f).drop("timestamp_ms", *names)


PEAKS = with_views("timeline", """, p AS (SELECT *, motion_score >= 50 AND motion_score > coalesce(lag(motion_score) OVER w, '-inf'::DOUBLE) AND motion_score >= coalesce(lead(motion_score) OVER w, '-inf'::DOUBLE) AS is_peak
  FROM timeline WINDOW w AS (PARTITION BY video_id ORDER BY timestamp_ms, frame_id))""")


@query(PEAKS + " SELECT video_id, frame_id FROM p WHERE is_peak")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return seq.peaks(views.timeline(spark, d), 50).where("is_peak").select("video_id", "frame_id")


@query(with_views("timeline", " SELECT video_id, frame_id FROM timeline QUALIFY motion_score >= 50 AND motion_score = max(motion_score) OVER (PARTITION BY video_id ORDER BY timestamp_ms, frame_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"))
def motion_peaks(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("video_id").orderBy("timestamp_ms", "frame_id").rowsBetween(-1, 1)
    t = views.timeline(spark, d).withColumn("top", F.max("motion_score").over(w))
    return t.where("motion_score >= 50 and motion_score = top").select("video_id", "frame_id")


@query(PEAKS + " SELECT frame_id, video_id, (sum(is_peak::INT) OVER (PARTITION BY video_id ORDER BY timestamp_ms, frame_id))::BIGINT AS shot_id FROM p")
def shot_ids(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("video_id").orderBy("timestamp_ms", "frame_id").rowsBetween(W.unboundedPreceding, 0)
    return seq.peaks(views.timeline(spark, d), 50).select("frame_id", "video_id", F.sum(F.col("is_peak").cast("int")).over(w).alias("shot_id"))


@query(PEAKS.replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (SELECT video_id, frame_idx AS centre, timestamp_ms AS t FROM p WHERE is_peak AND motion_score >= 80),
  n AS (SELECT c.video_id, c.centre, p.frame_idx AS i, p.frame_id, p.timestamp_ms AS t FROM c JOIN p ON p.video_id = c.video_id AND p.timestamp_ms BETWEEN c.t - 20000 AND c.t + 20000),
  r(video_id, centre, i, frame_id, last, keep) AS (SELECT video_id, centre, i, frame_id, t, true FROM n QUALIFY row_number() OVER (PARTITION BY video_id, centre ORDER BY i) = 1 UNION ALL
    SELECT n.video_id, n.centre, n.i, n.frame_id, CASE WHEN n.i = n.centre OR n.t - r.last >= 5000 THEN n.t ELSE r.last END, n.i = n.centre OR n.t - r.last >= 5000
    FROM r JOIN n ON n.video_id = r.video_id AND n.centre = r.centre AND n.i = r.i + 1)
  SELECT DISTINCT video_id, frame_id FROM r WHERE keep""")
def burst_thinning(spark: SparkSession, d: str) -> DataFrame:
    """Frames within twenty seconds of strong peaks, five seconds apart, and the peaks."""
    rows = seq.peaks(views.timeline(spark, d), 80).select("video_id", "frame_id", "timestamp_ms", "is_peak")
    f = lambda p: seq.thinned(p["timestamp_ms"].to_numpy(), p["is_peak"].to_numpy(bool), 20000, 5000)
    return seq.fold(rows, "video_id", ["timestamp_ms", "frame_id"], "keep", "boolean", f).where("keep").select("video_id", "frame_id")


@query(PEAKS.replace("WITH ", "WITH RECURSIVE ", 1) + """, l AS (SELECT video_id, frame_idx AS i, frame_id, timestamp_ms AS t, is_peak,
    round_even(30000 - least(motion_score / 80.0::DOUBLE, 1) * 20000, 0) AS gap FROM p),
  r(video_id, i, last, last_t, anchor) AS (SELECT video_id, i, i, t, NULL::BIGINT FROM l WHERE i = 0 UNION ALL
    SELECT x.video_id, x.i, CASE WHEN x.is_peak THEN x.i WHEN x.reached THEN x.chosen ELSE x.last END, CASE WHEN x.is_peak THEN x.t WHEN x.reached THEN a.t ELSE x.last_t END, CASE WHEN x.reached THEN x.chosen END
    FROM (SELECT l.video_id, l.i, l.t, l.is_peak, r.last, r.last_t, l.t - r.last_t >= l.gap AS reached, greatest(l.i - 1, r.last + 1) AS chosen FROM r JOIN l ON l.video_id = r.video_id AND l.i = r.i + 1) x
    JOIN l a ON a.video_id = x.video_id AND a.i = x.chosen)
  SELECT l.video_id, l.frame_id FROM r JOIN l ON l.video_id = r.video_id AND l.i = r.anchor""")
def coverage_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept besides the peaks so that gaps stay under 30 seconds, or less where there is motion."""
    rows = seq.peaks(views.timeline(spark, d), 50).select("video_id", "frame_id", "timestamp_ms", "motion_score", "is_peak")
    f = lambda p: seq.coverage_anchors(p["timestamp_ms"].to_numpy(), p["motion_score"].to_numpy(), p["is_peak"].to_numpy(bool), 80, 30000, 10000)
    return seq.fold(rows, "video_id", ["timestamp_ms", "frame_id"], "anchor", "boolean", f).where("anchor").select("video_id", "frame_id")


@query(with_views("frames", """, f AS (SELECT *, frame_idx // 8 AS shot, (frame_id % 10) / 10.0::DOUBLE AS motion, frame_id % 11 = 0 AS protected, frame_id % 3 = 0 AS text FROM frames),
  r(video_id, i, last, frame_id, keep) AS (SELECT video_id, frame_idx, frame_idx, frame_id, true FROM f WHERE frame_idx = 0 UNION ALL
    SELECT video_id, i, CASE WHEN keep THEN i ELSE last END, frame_id, keep FROM (SELECT n.video_id, n.frame_idx AS i, r.last, n.frame_id,
      n.protected OR NOT (n.shot = k.shot AND n.timestamp_ms - k.timestamp_ms <= 4000 AND n.motion <= 0.7 AND n.text = k.text AND list_cosine_similarity(n.embedding::DOUBLE[], k.embedding::DOUBLE[]) >= 0.1) AS keep
      FROM r JOIN f n ON n.video_id = r.video_id AND n.frame_idx = r.i + 1 JOIN f k ON k.video_id = r.video_id AND k.frame_idx = r.last))
  SELECT video_id, frame_id, keep FROM r""").replace("WITH ", "WITH RECURSIVE ", 1))
def frame_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a shot that are much like the last kept one go, unless they are protected or show other text."""
    i = F.col("frame_id")
    rows = views.frames(spark, d).select(
        "video_id", "frame_id", "timestamp_ms", "embedding", F.expr("frame_idx div 8").alias("shot"), ((i % 10) / 10.0).alias("motion"),
        (i % 11 == 0).alias("protected"), (i % 3 == 0).alias("text"),
    )
    columns = ("timestamp_ms", "shot", "motion", "protected", "text")

    def keep(p):
        times, shots, motion, protected, text = (p[c].to_numpy() for c in columns)
        return seq.dedup_against_kept(times, shots, motion, np.stack(p["embedding"].to_list()).astype(float), protected, text, 4000, 0.7, 0.1)

    return seq.fold(rows, "video_id", ["timestamp_ms", "frame_id"], "keep", "boolean", keep).select("video_id", "frame_id", "keep")


@query(with_views("timeline", """, o AS (SELECT video_id, frame_idx AS i, frame_id, timestamp_ms AS t, frame_id % 7 = 0 OR frame_idx = 0 AS kept, frame_id % 7 = 0 AS own FROM timeline),
  n AS (SELECT *, min(CASE WHEN own THEN i END) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS target,
    max(i) OVER (PARTITION BY video_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 15000 FOLLOWING) AS reach, bool_or(own) OVER (PARTITION BY video_id) AS owns FROM o),
  r(video_id, i, status) AS (SELECT video_id, i, 1 FROM n WHERE i = 0 AND owns UNION ALL
    SELECT r.video_id, CASE WHEN n.reach >= n.target OR n.reach = n.i THEN n.target ELSE n.reach END, CASE WHEN n.reach >= n.target OR n.reach > n.i THEN 1 ELSE 2 END
    FROM r JOIN n ON n.video_id = r.video_id AND n.i = r.i WHERE n.target IS NOT NULL)
  SELECT o.video_id, o.frame_id, coalesce(r.status, 0)::BIGINT AS status FROM o LEFT JOIN r USING (video_id, i)""").replace("WITH ", "WITH RECURSIVE ", 1))
def gap_repair(spark: SparkSession, d: str) -> DataFrame:
    """Rows put back so that no gap between kept ones is over 15 seconds; 2 marks where that can't be done."""
    rows = views.timeline(spark, d).select("video_id", "frame_id", "timestamp_ms", (F.col("frame_id") % 7 == 0).alias("kept"))
    f = lambda p: seq.repaired(p["timestamp_ms"].to_numpy(), p["kept"].to_numpy(bool), 15000)
    return seq.fold(rows, "video_id", ["timestamp_ms", "frame_id"], "status", "long", f).select("video_id", "frame_id", "status")


@query(with_views(_HITS, """, o AS (SELECT query_id, video_id, frame_id, timestamp_ms AS t, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS i FROM hits),
  r(query_id, video_id, frame_id, i, kept, kept_by) AS (SELECT query_id, video_id, frame_id, i, [{'t': t, 'f': frame_id}], frame_id FROM o WHERE i = 1 UNION ALL
    SELECT query_id, video_id, frame_id, i, CASE WHEN prior IS NULL THEN list_append(kept, {'t': t, 'f': frame_id}) ELSE kept END, coalesce(prior, frame_id) FROM
    (SELECT o.*, r.kept, list_filter(r.kept, lambda k: abs(k.t - o.t) <= 6000)[1].f AS prior FROM r JOIN o ON o.query_id = r.query_id AND o.video_id = r.video_id AND o.i = r.i + 1))
  SELECT query_id, video_id, frame_id, kept_by FROM r""").replace("WITH ", "WITH RECURSIVE ", 1))
def temporal_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a query and video, best first, within six seconds of a kept one are its alternates."""
    h = hits(spark, d).select("query_id", "video_id", "frame_id", "timestamp_ms", "rank")
    f = lambda p: p["frame_id"].to_numpy()[seq.temporal_nms(p["timestamp_ms"].to_numpy(), 6000)]
    return seq.fold(h, ["query_id", "video_id"], ["rank"], "kept_by", "long", f).select("query_id", "video_id", "frame_id", "kept_by")


@query(with_views(_HITS, """, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS nth FROM hits),
  e AS (SELECT *, nth <= 2 AND sum((nth <= 2)::INT) OVER (PARTITION BY query_id ORDER BY rank) <= 20 AS early FROM c)
  SELECT query_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY NOT early, rank)::INTEGER AS place FROM e"""))
def early_diversity(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).select("query_id", "video_id", "frame_id", "rank")
    return seq.early_diversity(h, "query_id", 20, 2).select("query_id", "frame_id", "place")


@query(with_views(_HITS, """, w AS (SELECT query_id * 1000000 + video_id AS k, greatest(0, timestamp_ms - 3000) AS start_ms, timestamp_ms + 3000 AS end_ms, score FROM hits),
  i AS (SELECT *, sum(CASE WHEN prior IS NULL OR start_ms > prior THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM
  (SELECT *, max(end_ms) OVER (PARTITION BY k ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM w))
  SELECT k, min(start_ms) AS start_ms, max(end_ms) AS end_ms, round(max(score) + 0.05::DOUBLE * least(count(*) - 1, 4), 6) AS score, count(*) AS windows FROM i GROUP BY k, island"""))
def window_coalescing(spark: SparkSession, d: str) -> DataFrame:
    w = hits(spark, d).select((F.col("query_id") * 1000000 + F.col("video_id")).alias("k"), F.greatest(F.lit(0), F.col("timestamp_ms") - 3000).alias("start_ms"), (F.col("timestamp_ms") + 3000).alias("end_ms"), "score")
    return seq.coalesced(w, "k").drop("island")


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1))"


@query(with_views("segments", f""", q AS (SELECT video_id, {_TERMS.format("text")} AS asked FROM segments WHERE segment_index = 0),
  b AS (SELECT s.video_id, segment_id, start_ms - 6000 AS a, end_ms + 6000 AS b, round((length(text) % 37) / 37.0::DOUBLE + 0.25::DOUBLE * len(list_intersect(asked, {_TERMS.format("text")})) / greatest(1, len(asked)), 9) AS score
    FROM segments s JOIN q USING (video_id)),
  o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, a, segment_id) AS i FROM b),""" + """
  r(video_id, i, segment_id, score, kept, keep) AS (SELECT video_id, i, segment_id, score, [{'a': a, 'b': b}], true FROM o WHERE i = 1 UNION ALL
    SELECT video_id, i, segment_id, score, CASE WHEN keep THEN list_append(kept, {'a': a, 'b': b}) ELSE kept END, keep FROM
    (SELECT o.*, r.kept, len(list_filter(r.kept, lambda k: least(k.b, o.b) - greatest(k.a, o.a) > 0.6::DOUBLE * greatest(1, least(k.b - k.a, o.b - o.a)))) = 0 AS keep FROM r JOIN o ON o.video_id = r.video_id AND o.i = r.i + 1))
  SELECT video_id, segment_id, score, keep FROM r""").replace("WITH ", "WITH RECURSIVE ", 1))
def window_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Windows around a conversation's turns by score and by what they share with its first turn, the question; those that
    overlap a better one by over 0.6 of the shorter go."""
    s = views.segments(spark, d)
    asked = s.where("segment_index = 0").select("video_id", F.col("text").alias("asked"))
    score = (F.length("text") % 37) / 37.0 + 0.25 * text.token_overlap(F.col("asked"), F.col("text"))
    w = s.join(asked, "video_id").select(
        "video_id", "segment_id", (F.col("start_ms") - 6000).alias("a"), (F.col("end_ms") + 6000).alias("b"), F.round(score, 9).alias("score")
    )
    w = w.withColumn("less", -F.col("score"))
    f = lambda p: seq.interval_nms(p["a"].to_numpy(), p["b"].to_numpy(), 0.6)
    return seq.fold(w, "video_id", ["less", "a", "segment_id"], "keep", "boolean", f).select("video_id", "segment_id", "score", "keep")


def _sampled(source: str, keys: str, most: int) -> str:
    """SQL: (keys, frame_id) of the rows of ``source`` (keys, i, n, frame_id, required) that ``sampled`` takes."""
    places = f"list_transform(range({most}), lambda k: round_even(k * (n - 1) / {most - 1}.0::DOUBLE, 0)::INTEGER)"
    choice = f"CASE WHEN required THEN 0 WHEN list_contains({places}, i::INTEGER) THEN 1 ELSE 2 END"
    return f"SELECT {keys}, frame_id FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {choice}, i) <= {most}"


@query(with_views("timeline", """, c AS (SELECT video_id, frame_id, frame_idx AS i, count(*) OVER (PARTITION BY video_id) AS n, motion_score >= 150 AS required FROM timeline) """ + _sampled("c", "video_id", 5)))
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five rows of each video: those of most motion, then those at even places."""
    t = views.timeline(spark, d).select("video_id", "frame_id", "timestamp_ms", (F.col("motion_score") >= 150).alias("required"))
    return seq.sampled(t, ["video_id"], ["timestamp_ms", "frame_id"], 5, "required").select("video_id", "frame_id")


@query(with_views("segments", " SELECT video_id, count(*) FILTER (WHERE start_ms < prior) AS overlaps, count(*) FILTER (WHERE end_ms <= start_ms) AS empty FROM (SELECT *, lag(end_ms) OVER (PARTITION BY video_id ORDER BY segment_index) AS prior FROM segments) GROUP BY video_id"))
def interval_violations(spark: SparkSession, d: str) -> DataFrame:
    prior = F.lag("end_ms").over(W.partitionBy("video_id").orderBy("segment_index"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = views.segments(spark, d).withColumn("prior", prior)
    return s.groupBy("video_id").agg(n(F.col("start_ms") < F.col("prior")).alias("overlaps"), n(F.col("end_ms") <= F.col("start_ms")).alias("empty"))


@query(with_views("timeline", """, s AS (SELECT video_id, frame_idx, frame_idx // 3 AS j, motion_score AS m FROM timeline WHERE frame_idx % 3 = 0),
  w AS (SELECT video_id, frame_idx, avg(m * (1 + 0.01::DOUBLE * (j - 4 * k))) AS v FROM (SELECT *, unnest([j // 4, j // 4 - 1]) AS k FROM s) WHERE k >= 0 GROUP BY ALL),
  f AS (SELECT t.video_id, t.frame_id, t.frame_idx AS i, w.v, CASE WHEN w.v IS NOT NULL THEN t.frame_idx END AS seen FROM timeline t LEFT JOIN w USING (video_id, frame_idx)),
  n AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, last_value(seen IGNORE NULLS) OVER p AS ia, first_value(v IGNORE NULLS) OVER c AS b, first_value(seen IGNORE NULLS) OVER c AS ib FROM f
    WINDOW p AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT video_id, frame_id, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL OR ia = ib THEN a ELSE a + (b - a) * (i - ia) / (ib - ia) END, 6) AS filled FROM n"""))
def score_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """Every third frame is scored in windows of eight, four apart; scores are averaged, and spread linearly over the
    frames between."""
    t = views.timeline(spark, d).select("video_id", "frame_id", "frame_idx", "motion_score")
    s = t.where("frame_idx % 3 = 0").withColumn("j", F.expr("frame_idx div 3"))
    s = s.withColumn("k", F.explode(F.array(F.expr("j div 4"), F.expr("j div 4") - 1))).where("k >= 0")
    scored = s.groupBy("video_id", "frame_idx").agg(F.avg(F.col("motion_score") * (1 + 0.01 * (F.col("j") - 4 * F.col("k")))).alias("v"))
    rows = t.join(scored, ["video_id", "frame_idx"], "left")
    return rows.select("video_id", "frame_id", F.round(seq.interpolated("v", "frame_idx", "video_id"), 6).alias("filled"))


@query(with_views(_HITS, """, s AS (SELECT query_id, video_id, timestamp_ms // 20000 AS scene, min(timestamp_ms) AS a, max(timestamp_ms) AS b FROM hits GROUP BY ALL),
  r AS (SELECT h.query_id, h.frame_id, h.score, h.video_id, s.scene FROM hits h JOIN s ON h.query_id = s.query_id AND h.video_id = s.video_id AND h.timestamp_ms // 20000 = s.scene
  QUALIFY row_number() OVER (PARTITION BY h.query_id, h.video_id, s.scene ORDER BY h.score DESC, abs(h.timestamp_ms - (a + b) // 2), h.frame_idx) = 1)
  SELECT query_id, video_id, scene, frame_id FROM r QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY query_id, scene) = 1"""))
def scene_representatives(spark: SparkSession, d: str) -> DataFrame:
    """The best frame of each scene, nearest its middle among equals; a frame stands for one scene only."""
    h = hits(spark, d).withColumn("scene", F.expr("timestamp_ms div 20000"))
    keys = ["query_id", "video_id", "scene"]
    spans = h.groupBy(*keys).agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b"))
    order = F.struct("score", (-F.abs(F.col("timestamp_ms") - F.expr("(a + b) div 2"))).alias("near"), (-F.col("frame_idx")).alias("early"), "frame_id")
    best = h.join(spans, keys).groupBy(*keys).agg(F.max(order).alias("m")).select(*keys, F.col("m.frame_id").alias("frame_id"))
    return fusion.first_per(best, ["frame_id"], [F.col("query_id"), F.col("scene")])


@query(with_views("timeline", " SELECT a.frame_id, b.frame_id AS other_id FROM timeline a JOIN timeline b ON a.video_id = b.video_id AND b.frame_idx BETWEEN a.frame_idx - 2 AND a.frame_idx + 2"))
def window_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Two neighbours on either side, by place."""
    t = views.timeline(spark, d).select("video_id", "frame_id", "frame_idx")
    around = F.explode(F.sequence(F.col("frame_idx") - 2, F.col("frame_idx") + 2))
    a = t.withColumn("at", around).select("video_id", "frame_id", F.col("at").alias("frame_idx"))
    return a.join(t.withColumnRenamed("frame_id", "other_id"), ["video_id", "frame_idx"]).select("frame_id", "other_id")


@query(with_views(_HITS, """, s AS (SELECT query_id, video_id, timestamp_ms // 20000 AS scene, min(timestamp_ms) - 8000 AS a, max(timestamp_ms) + 8000 AS b, count(*) AS had FROM hits GROUP BY ALL),
  f AS (SELECT s.query_id, s.video_id, s.scene, f.frame_id, h.frame_id IS NOT NULL AS required, had, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s.query_id, s.video_id, s.scene) AS n
    FROM s JOIN frames f ON f.video_id = s.video_id AND f.timestamp_ms BETWEEN s.a AND s.b LEFT JOIN hits h ON h.query_id = s.query_id AND h.frame_id = f.frame_id AND h.timestamp_ms // 20000 = s.scene
    WINDOW w AS (PARTITION BY s.query_id, s.video_id, s.scene ORDER BY f.timestamp_ms, f.frame_idx, f.frame_id)), g AS (SELECT * FROM f WHERE n > had) """ + _sampled("g", "query_id, video_id, scene", 6)))
def fallback_windows(spark: SparkSession, d: str) -> DataFrame:
    """Scenes widened by eight seconds on either side, six frames of each, its own first; none where nothing is gained."""
    keys = ["query_id", "video_id", "scene"]
    h = hits(spark, d).select("query_id", "video_id", "frame_id", "timestamp_ms", F.expr("timestamp_ms div 20000").alias("scene"))
    h = shared.written(h, "scene-hits")
    s = h.groupBy(*keys).agg((F.min("timestamp_ms") - 8000).alias("l_start"), (F.max("timestamp_ms") + 8001).alias("l_end"), F.count("*").alias("had"))
    f = views.frames(spark, d).select("video_id", "frame_id", "frame_idx", "timestamp_ms")
    f = f.withColumns({"r_start": F.col("timestamp_ms"), "r_end": F.col("timestamp_ms") + 1})
    rows = joins.overlap_join(s, f, "video_id", 40_000).withColumn("n", F.count("*").over(W.partitionBy(*keys))).where("n > had")
    own = h.select(*keys, "frame_id", F.lit(True).alias("own"))
    rows = rows.join(own, [*keys, "frame_id"], "left").withColumn("required", F.coalesce("own", F.lit(False)))
    return seq.sampled(rows, keys, ["timestamp_ms", "frame_idx", "frame_id"], 6, "required").select(*keys, "frame_id")


@query(with_views(_HITS, " SELECT query_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN -(frame_id % 13) ELSE 0 END, rank)::INTEGER AS place FROM hits"))
def rerank_top(spark: SparkSession, d: str) -> DataFrame:
    """The best ten by a second score, the tail as it was."""
    top = F.col("rank") <= 10
    order = W.partitionBy("query_id").orderBy(F.when(top, 0).otherwise(1), F.when(top, -(F.col("frame_id") % 13)).otherwise(0), "rank")
    return hits(spark, d).select("query_id", "frame_id", F.row_number().over(order).alias("place"))


@query("SELECT conv_id, turn, place::INTEGER AS place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (role <> 'user'), length(text), turn) AS place FROM conversations) WHERE place <= 3")
def question_evidence_order(spark: SparkSession, d: str) -> DataFrame:
    c = views.read(spark, d, "conversations").withColumn("len", F.length("text"))
    return fusion.top_per(c, ["conv_id"], [F.col("role") != "user", F.col("len"), F.col("turn")], 3, "place").select("conv_id", "turn", "place")


@query(with_views(_HITS, """, a AS (SELECT query_id, CASE WHEN rank % 11 = 0 THEN -frame_id WHEN rank % 7 = 0 THEN frame_id + 1 ELSE frame_id END AS frame_id, video_id, frame_idx % 3 AS answer, rank FROM hits),
  f AS (SELECT a.query_id, frames.video_id, frames.frame_idx, frames.frame_id, answer, rank AS was FROM a JOIN frames USING (frame_id) WHERE frames.video_id = a.video_id
    QUALIFY row_number() OVER (PARTITION BY a.query_id, frames.video_id, frames.frame_idx, answer ORDER BY rank) = 1)
  SELECT query_id, video_id, frame_idx, frame_id, answer, row_number() OVER (PARTITION BY query_id ORDER BY was)::INTEGER AS rank FROM f QUALIFY rank <= 20"""))
def submission_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Ranked answers as the twenty rows to hand in: some name a frame that doesn't exist, or one of another video."""
    named = F.when(F.col("rank") % 11 == 0, -F.col("frame_id")).when(F.col("rank") % 7 == 0, F.col("frame_id") + 1).otherwise(F.col("frame_id"))
    ranked = hits(spark, d).select("query_id", named.alias("frame_id"), "video_id", (F.col("frame_idx") % 3).alias("answer"), "rank")
    return fusion.submissions(ranked, views.frames(spark, d), 20)


@query(with_views("timeline", " SELECT video_id, frame_id, row_number() OVER (ORDER BY video_id, timestamp_ms, frame_id) - 1 AS position FROM timeline"))
def corpus_order(spark: SparkSession, d: str) -> DataFrame:
    """The corpus in its order: ranges sorted apart, whose positions are offsets of videos and places within."""
    t = views.timeline(spark, d)
    before = W.orderBy("video_id").rowsBetween(W.unboundedPreceding, -1)  # a row for each video
    offsets = t.groupBy("video_id").agg(F.count("*").alias("n")).select("video_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = t.join(offsets, "video_id").select("video_id", "frame_id", (F.col("before") + F.col("frame_idx")).alias("position"))
    return out.repartitionByRange("position").sortWithinPartitions("position")


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
  r(conv_id, turn, i, total, chunk) AS (SELECT conv_id, turn, i, n, 0::BIGINT FROM o WHERE i = 1 UNION ALL
    SELECT o.conv_id, o.turn, o.i, CASE WHEN r.total > 0 AND r.total + o.n > 900 THEN o.n ELSE r.total + o.n END, r.chunk + (r.total > 0 AND r.total + o.n > 900)::BIGINT
    FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1) SELECT conv_id, turn, chunk FROM r""")
def size_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation in order, in chunks of at most 900 characters."""
    rows = views.read(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return seq.fold(rows, "conv_id", ["turn"], "chunk", "long", lambda p: seq.next_fit(p["n"].to_numpy(), 900)).select("conv_id", "turn", "chunk")


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, unnest([0, 1, 2]) AS source, unnest([role, split_part(text, '.', 1), text]) AS v FROM conversations),
  o AS (SELECT conv_id, turn, source, trim(regexp_replace(v, '\\s+', ' ', 'g')) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn, source) AS i FROM s),
  k AS (SELECT *, length(v) AS n, source || ':' || lower(v) AS k FROM o),
  r(conv_id, turn, source, i, room, seen, used) AS (SELECT conv_id, turn, source, i, CASE WHEN n BETWEEN 1 AND 600 THEN 600 - n ELSE 600 END, CASE WHEN n BETWEEN 1 AND 600 THEN [k] ELSE []::VARCHAR[] END, n BETWEEN 1 AND 600 FROM k WHERE i = 1 UNION ALL
    SELECT conv_id, turn, source, i, CASE WHEN fits THEN room - n ELSE room END, CASE WHEN fits THEN list_append(seen, k) ELSE seen END, fits FROM
    (SELECT k.*, r.room, r.seen, k.n BETWEEN 1 AND r.room AND NOT list_contains(r.seen, k.k) AND len(r.seen) < 8 AS fits FROM r JOIN k ON k.conv_id = r.conv_id AND k.i = r.i + 1))
  SELECT conv_id, turn, source, used FROM r""")
def evidence_budget(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a conversation by turn and source (speaker, first sentence, text): what is new and fits in 600
    characters, eight pieces at most; what does not is passed over."""
    pieces = F.posexplode(F.array("role", F.substring_index("text", ".", 1), "text")).alias("source", "v")
    rows = views.read(spark, d, "conversations").select("conv_id", "turn", pieces).withColumn("v", text.collapse(F.col("v")))
    rows = rows.select("conv_id", "turn", "source", F.length("v").alias("n"), F.concat_ws(":", F.col("source").cast("string"), F.lower("v")).alias("k"))
    f = lambda p: seq.within_budget(p["n"].to_numpy(), p["k"].tolist(), 600, 8)
    return seq.fold(rows, "conv_id", ["turn", "source"], "used", "boolean", f).select("conv_id", "turn", "source", "used")


@query(with_views(_HITS, """, s AS (SELECT query_id, video_id, timestamp_ms // 20000 AS scene, min(timestamp_ms) AS a, max(timestamp_ms) AS b FROM hits GROUP BY ALL),
  f AS (SELECT s.query_id, s.video_id, s.scene, f.frame_id, row_number() OVER (PARTITION BY s.query_id, s.video_id, s.scene ORDER BY f.timestamp_ms, f.frame_idx, f.frame_id) - 1 AS i, count(*) OVER (PARTITION BY s.query_id, s.video_id, s.scene) AS n
    FROM s JOIN frames f ON f.video_id = s.video_id AND f.timestamp_ms BETWEEN s.a AND s.b)
  SELECT DISTINCT query_id, video_id, scene, frame_id FROM f, generate_series(0, 3) g(k) WHERE n <= 4 OR i = round_even(k * (n - 1) / 3.0::DOUBLE, 0)"""))
def scene_bundles(spark: SparkSession, d: str) -> DataFrame:
    """The frames within each scene's span, by time bins of the scene's length; of more than four, four at even places."""
    keys = ["query_id", "video_id", "scene"]
    s = hits(spark, d).groupBy("query_id", "video_id", F.expr("timestamp_ms div 20000").alias("scene"))
    s = s.agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b"))
    f = views.frames(spark, d).select("video_id", "frame_id", "frame_idx", "timestamp_ms", F.expr("timestamp_ms div 20000").alias("scene"))
    own = W.partitionBy(*keys)
    rows = s.join(f, ["video_id", "scene"]).where("timestamp_ms between a and b")
    rows = rows.withColumns({"i": F.row_number().over(own.orderBy("timestamp_ms", "frame_idx", "frame_id")) - 1, "n": F.count("*").over(own)})
    places = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.bround(k * (F.col("n") - 1) / 3.0).cast("int"))
    return rows.where((F.col("n") <= 4) | F.array_contains(places, F.col("i"))).select(*keys, "frame_id")


@query(with_views("frames queries hits text_hits", """, r AS (SELECT query_id, frame_id, 1.0::DOUBLE / (60 + rank) AS s FROM hits UNION ALL SELECT query_id, frame_id, 0.5::DOUBLE / (60 + rank) FROM text_hits),
  fused AS (SELECT query_id, frame_id, round(sum(s), 9) AS fusion FROM r GROUP BY ALL), v AS (SELECT query_id, frame_id, fusion, video_id, timestamp_ms FROM fused JOIN frames USING (frame_id)),
  j AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap <= 5000 THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, video_id ORDER BY timestamp_ms, frame_id) AS scene FROM
    (SELECT *, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY query_id, video_id ORDER BY timestamp_ms, frame_id) AS gap FROM v)),
  s AS (SELECT query_id, video_id, scene, round(0.9::DOUBLE * max(fusion) * 60 / 1.5 + 0.1::DOUBLE / (1 + (max(timestamp_ms) - min(timestamp_ms)) / 10000.0::DOUBLE), 6) AS scene_score, arg_max(frame_id, (fusion, -frame_id)) AS frame_id, count(*) AS frames FROM j GROUP BY ALL)
  SELECT query_id, video_id, frame_id, frames, scene_score, row_number() OVER (PARTITION BY query_id ORDER BY scene_score DESC, frame_id)::INTEGER AS rank FROM s QUALIFY rank <= 10"""))
def kis_search(spark: SparkSession, d: str) -> DataFrame:
    """Known-item search end to end: hits of two searches, fused; their frames grouped into scenes; scenes scored by meaning
    and compactness; the best frame stands for its scene."""
    both = fusion.union_sources({"visual": hits(spark, d), "text": text_hits(spark, d)})
    fused = fusion.reciprocal_rank(both, {"visual": 1.0, "text": 0.5})
    frames = views.frames(spark, d).select("frame_id", "video_id", "timestamp_ms")
    found = fused.select("query_id", "frame_id", "fusion_score").join(frames, "frame_id")
    joined = seq.gap_sessions(found, ["query_id", "video_id"], "timestamp_ms", 5000, "frame_id")
    span = (F.max("timestamp_ms") - F.min("timestamp_ms")) / 10000.0
    best = F.max(F.struct("fusion_score", (-F.col("frame_id")).alias("less")))
    s = joined.groupBy("query_id", "video_id", "session").agg(
        F.round(0.9 * F.max("fusion_score") * 60 / 1.5 + 0.1 / (1 + span), 6).alias("scene_score"), (-best["less"]).alias("frame_id"), F.count("*").alias("frames")
    )
    return fusion.top_per(s, ["query_id"], [F.desc("scene_score"), F.col("frame_id")], 10).drop("session")
