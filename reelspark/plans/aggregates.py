"""Queries of aggregates: duplicates, summaries, votes, scores, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import evidence, fusion, vector
from ..sources import shared, views
from ..sources.views import with_views
from .registry import query
from .relational import hits, two_sources

_HITS = "frames queries hits"


@query("SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows, coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM events GROUP BY user_id % 100, event_id % 500 HAVING count(*) > 1)")
def duplicate_coordinates(spark: SparkSession, d: str) -> DataFrame:
    n = views.read(spark, d, "events").groupBy((F.col("user_id") % 100).alias("v"), (F.col("event_id") % 500).alias("i")).agg(F.count("*").alias("n"))
    return n.where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


@query(with_views("detections", """, c AS (SELECT video_id, day, label, count(*) AS n, max(confidence) AS best FROM detections WHERE confidence >= 0.3 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY video_id, day ORDER BY n DESC, best DESC, label) AS place FROM c)
  SELECT video_id, day, string_agg(label || ' x' || n, '; ' ORDER BY place) FILTER (WHERE place <= 3) AS summary, sum(n)::BIGINT AS detection_count FROM r GROUP BY ALL"""))
def object_summaries(spark: SparkSession, d: str) -> DataFrame:
    return evidence.object_summary(views.detections(spark, d), ["video_id", "day"], 0.3, 3)


_TASKS = "frames queries tasks hits"


def task_hits(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The hits of each task's events."""
    tasks = views.tasks(spark, d).select("query_id", "task", "event")
    return hits(spark, d, k).join(tasks, "query_id")


SHORTLIST = with_views(_TASKS, """, f AS (SELECT task, event, video_id, min(rank) - 1 AS rank0 FROM hits JOIN tasks USING (query_id) GROUP BY ALL),
  v AS (SELECT task, video_id, count(*) AS coverage, round(sum(1.0::DOUBLE / (60 + rank0)), 9) AS votes FROM f GROUP BY ALL)""")


@query(SHORTLIST + " SELECT *, row_number() OVER (PARTITION BY task ORDER BY coverage DESC, votes DESC, video_id)::INTEGER AS place FROM v QUALIFY place <= 5")
def video_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return fusion.video_shortlist(task_hits(spark, d), "event", top=5, by=("task",))


@query(with_views(_HITS, ", b AS (SELECT query_id, video_id, max(score) AS best FROM hits GROUP BY ALL) SELECT query_id, least(0, min(best)) AS low, max(best) AS high FROM b GROUP BY query_id"))
def unit_bounds(spark: SparkSession, d: str) -> DataFrame:
    return evidence.bounds(hits(spark, d), "query_id")


POOL = with_views(_TASKS, """, h AS (SELECT hits.*, task, event FROM hits JOIN tasks USING (query_id)),
  b AS (SELECT task, event, video_id, max(score) AS best FROM h WHERE rank <= 20 GROUP BY ALL),
  u AS (SELECT task, event, least(0, min(best)) AS low, max(best) AS high FROM b GROUP BY ALL),
  s AS (SELECT task, video_id, round(avg(CASE WHEN high <= low THEN 1.0::DOUBLE ELSE least(1, greatest(0, (best - low) / (high - low))) END), 9) AS semantic, count(*) AS matched
    FROM b JOIN u USING (task, event) GROUP BY ALL),
  e AS (SELECT task, video_id, count(DISTINCT event) AS evaluated FROM h GROUP BY ALL),
  pool AS (SELECT task, video_id, coalesce(semantic, 0) AS semantic, coalesce(matched, 0) AS matched, evaluated,
    round(0.45::DOUBLE * coalesce(semantic, 0) + 0.25::DOUBLE * coalesce(matched, 0) / 3 + 0.30::DOUBLE * evaluated / 3, 12) AS score FROM e LEFT JOIN s USING (task, video_id))""")


@query(POOL + " SELECT * FROM pool")
def candidate_video_scores(spark: SparkSession, d: str) -> DataFrame:
    h = task_hits(spark, d)
    return evidence.video_scores(h.where("rank <= 20"), h.select("task", "event", "video_id"), "task", "event", 3)


@query(POOL + " SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, video_id)::INTEGER AS place FROM pool QUALIFY place <= 50")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best videos of each task."""
    return fusion.top_per(candidate_video_scores(spark, d), ["task"], [F.desc("score"), F.col("video_id")], 50, "place")


@query(with_views(_HITS, """ SELECT query_id, video_id, frame_id, score, timestamp_ms, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, timestamp_ms, frame_id) AS place FROM hits) WHERE place <= 5"""))
def evidence_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The best row of a frame, then the five best frames of each unit and video."""
    best = hits(spark, d).groupBy("query_id", "video_id", "frame_id", "timestamp_ms").agg(F.max("score").alias("score"))
    return fusion.top_per(best, ["query_id", "video_id"], [F.desc("score"), F.col("timestamp_ms"), F.col("frame_id")], 5, "place")


@query(with_views(_HITS, """ SELECT frame_id, round(max(score), 6) AS score, min(rank)::INTEGER AS rank, string_agg(query_id::VARCHAR, '|' ORDER BY query_id) AS provenance FROM hits GROUP BY frame_id"""))
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = hits(spark, d).groupBy("frame_id").agg(F.round(F.max("score"), 6).alias("score"), F.min("rank").alias("rank"), F.sort_array(F.collect_set("query_id")).alias("x"))
    return merged.select("frame_id", "score", "rank", F.array_join(F.col("x").cast("array<string>"), "|").alias("provenance"))


@query(with_views(_HITS, """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, frame_id) AS place FROM hits)
  SELECT query_id, video_id, round(max(score) + 0.25::DOUBLE * round(avg(score) FILTER (WHERE place <= 3), 9) + 0.05::DOUBLE * count(DISTINCT frame_idx % 3) + 0.03::DOUBLE * count(DISTINCT timestamp_ms // 15000)
  - 0.02::DOUBLE * greatest(0, count(*) - 2 * count(DISTINCT timestamp_ms // 15000)), 9) AS score FROM r GROUP BY ALL"""))
def video_aggregation(spark: SparkSession, d: str) -> DataFrame:
    """Best, mean of the best three, modalities and neighbourhoods, less what crowds one neighbourhood."""
    place = F.row_number().over(W.partitionBy("query_id", "video_id").orderBy(F.desc("score"), "frame_id"))
    places = F.count_distinct(F.expr("timestamp_ms div 15000"))
    score = (
        F.max("score")
        + 0.25 * F.round(F.avg(F.when(F.col("place") <= 3, F.col("score"))), 9)
        + 0.05 * F.count_distinct(F.col("frame_idx") % 3)
        + 0.03 * places
        - 0.02 * F.greatest(F.lit(0), F.count("*") - 2 * places)
    )
    return hits(spark, d).withColumn("place", place).groupBy("query_id", "video_id").agg(F.round(score, 9).alias("score"))


@query(with_views(_HITS, """, b AS (SELECT frame_id, query_id % 2 AS branch, max(score) * CASE query_id % 2 WHEN 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS s FROM hits GROUP BY frame_id, query_id % 2)
  SELECT frame_id, round((max(s) + 0.15::DOUBLE * sum(s)) * CASE WHEN frame_id % 3 = 0 THEN 1.15::DOUBLE ELSE 1 END, 6) AS score, count(*) AS branches FROM b GROUP BY frame_id"""))
def branch_merge(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("branch") == 0, 1.0).otherwise(0.9)
    b = hits(spark, d).groupBy("frame_id", (F.col("query_id") % 2).alias("branch")).agg(F.max("score").alias("s")).withColumn("s", F.col("s") * weight)
    boost = F.when(F.col("frame_id") % 3 == 0, 1.15).otherwise(1.0)
    return b.groupBy("frame_id").agg(F.max("s").alias("m"), F.sum("s").alias("t"), F.count("*").alias("branches")).select("frame_id", F.round((F.col("m") + 0.15 * F.col("t")) * boost, 6).alias("score"), "branches")


def _scaled(x: str) -> str:
    return f"CASE WHEN max({x}) OVER q > min({x}) OVER q THEN ({x} - min({x}) OVER q) / (max({x}) OVER q - min({x}) OVER q) ELSE 1 END"


@query("""WITH a AS (SELECT conv_id, turn, role AS answer, (length(text) % 7)::DOUBLE AS video_score, turn / 10.0::DOUBLE AS frame_score, length(text) % 11 <> 0 AS grounded,
    (length(text) % 13) / 13.0::DOUBLE AS localization, (length(text) % 17) / 17.0::DOUBLE AS coverage, (length(text) % 19) / 19.0::DOUBLE AS confidence FROM conversations),
  v AS (SELECT *, 0.5::DOUBLE * localization + 0.5::DOUBLE * coverage AS grounding, count(*) OVER (PARTITION BY conv_id, answer) / count(*) OVER (PARTITION BY conv_id) AS consistency FROM a WHERE grounded),
  j AS (SELECT conv_id, turn, answer, confidence, consistency, round(""" + " + ".join(f"0.2::DOUBLE * {_scaled(x)}" for x in ("video_score", "frame_score", "grounding", "confidence", "consistency")) + """, 9) AS joint_score
    FROM v WINDOW q AS (PARTITION BY conv_id))
  SELECT conv_id, turn, answer, round(consistency, 9) AS consistency, joint_score, row_number() OVER (PARTITION BY conv_id ORDER BY joint_score DESC, confidence DESC, turn)::INTEGER AS place FROM j""")
def answer_ranking(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's roles as answers to one question, their scores from the turns' lengths."""
    n, share = F.length("text"), lambda m: (F.length("text") % m) / float(m)
    rows = views.read(spark, d, "conversations").select(
        "conv_id", "turn", F.col("role").alias("answer_key"), (n % 11 != 0).alias("grounded"), (n % 7).cast("double").alias("video_score"),
        (F.col("turn") / 10.0).alias("frame_score"), share(13).alias("localization"), share(17).alias("coverage"), share(19).alias("confidence"),
        F.col("conv_id").alias("video_id"), F.col("turn").alias("start_ms"), F.col("turn").alias("frame_id"),
    )
    ranked = evidence.answer_ranking(rows, "conv_id")
    return ranked.select("conv_id", "turn", F.col("answer_key").alias("answer"), F.round("consistency", 9).alias("consistency"), "joint_score", "place")


METRIC = with_views("frames queries gold", """, r AS (SELECT query_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM
    (SELECT query_id, frame_id, round(list_inner_product(query::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM queries, frames) QUALIFY rank <= 100),
  q AS (SELECT r.query_id, min(rank) FILTER (WHERE g.frame_id IS NOT NULL) AS first_gold FROM r LEFT JOIN gold g USING (query_id, frame_id) GROUP BY r.query_id)""")


@query(METRIC + """ SELECT c.cutoff, avg((first_gold IS NOT NULL AND first_gold <= c.cutoff)::INT::DOUBLE) AS recall, count(*) AS queries, count(*) FILTER (WHERE first_gold IS NULL) AS failures
  FROM q, (VALUES (1), (5), (20), (50), (100)) c(cutoff) GROUP BY c.cutoff""")
def recall_at(spark: SparkSession, d: str) -> DataFrame:
    q = first_gold(spark, d, 100).withColumn("cutoff", F.explode(F.array(*map(F.lit, (1, 5, 20, 50, 100)))))
    hit = (F.col("first_gold").isNotNull() & (F.col("first_gold") <= F.col("cutoff"))).cast("double")
    return q.groupBy("cutoff").agg(F.avg(hit).alias("recall"), F.count("*").alias("queries"), F.sum(F.col("first_gold").isNull().cast("long")).alias("failures"))


def first_gold(spark: SparkSession, d: str, k: int) -> DataFrame:
    """For each query the first rank of a gold frame among the k best."""
    found = shared.written(hits(spark, d, k).select("query_id", "frame_id", "rank"), "found")
    gold = views.gold_of(spark, d, found).withColumn("gold", F.lit(True))
    h = found.join(gold, ["query_id", "frame_id"], "left")
    return h.groupBy("query_id").agg(F.min(F.when(F.col("gold"), F.col("rank"))).alias("first_gold"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(1000.0::DOUBLE * count(*) / sum(value), 6) AS qps FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "events").groupBy("event_type").agg(
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(1000.0 * F.count("*") / F.sum("value"), 6).alias("qps"),
    )


#: Weights that are tried: of likeness, and of lateness.
CONFIGURATIONS = [{"visual": v, "text": x} for v, x in ((1.0, 0.0), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0), (0.0, 1.0))]


@query(with_views("frames queries gold hits text_hits", """, m AS (SELECT query_id, frame_id, max(rank) FILTER (WHERE source = 'text') AS text, max(rank) FILTER (WHERE source = 'visual') AS visual FROM
    (SELECT query_id, 'visual' AS source, frame_id, rank FROM hits WHERE rank <= 30 UNION ALL
     SELECT query_id, 'text', frame_id, rank FROM text_hits) GROUP BY ALL),
  c AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {c['text']}::DOUBLE, {c['visual']}::DOUBLE)" for i, c in enumerate(CONFIGURATIONS)) + """) c(config, w_text, w_visual)),
  p AS (SELECT config, query_id, frame_id, row_number() OVER (PARTITION BY config, query_id ORDER BY round(coalesce(w_text / (60 + text), 0) + coalesce(w_visual / (60 + visual), 0), 12) DESC, frame_id) AS place FROM m, c),
  f AS (SELECT config, query_id, min(place) AS first FROM p JOIN gold USING (query_id, frame_id) GROUP BY ALL),
  s AS (SELECT config, w_text, w_visual, round(avg(((coalesce(first, 999) <= 1)::INT + (coalesce(first, 999) <= 5)::INT + (coalesce(first, 999) <= 20)::INT + (coalesce(first, 999) <= 50)::INT
    + (coalesce(first, 999) <= 100)::INT)::DOUBLE / 5), 9) AS score FROM c CROSS JOIN (SELECT DISTINCT query_id FROM gold) LEFT JOIN f USING (config, query_id) GROUP BY ALL)
  SELECT config::INTEGER AS config, w_text AS text, w_visual AS visual, score, row_number() OVER (ORDER BY score DESC, w_text, w_visual, config)::INTEGER AS place FROM s"""))
def weight_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Candidates fused anew with each setting of the weights; mean hits at the cut-offs, the best setting first."""
    ranked = two_sources(spark, d)
    out = fusion.calibrated(ranked, views.gold_of(spark, d, ranked), CONFIGURATIONS, asked=views.gold_queries(spark, d))
    return out.select("config", F.col("weights")["text"].alias("text"), F.col("weights")["visual"].alias("visual"), "score", "place")


@query(with_views("timeline", """, g AS (SELECT video_id, timestamp_ms, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY video_id ORDER BY timestamp_ms, frame_id) AS gap FROM timeline)
  SELECT video_id, round(avg(gap), 4) AS mean_gap, max(gap) AS max_gap, round(quantile_cont(gap, 0.95), 4) AS p95_gap, max(timestamp_ms) - min(timestamp_ms) AS duration_ms, count(*) AS frames, coalesce(max(gap) > 30000, false) AS sparse FROM g GROUP BY video_id"""))
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    lag = F.lag("timestamp_ms").over(W.partitionBy("video_id").orderBy("timestamp_ms", "frame_id"))
    g = views.timeline(spark, d).withColumn("gap", F.col("timestamp_ms") - lag)
    return g.groupBy("video_id").agg(
        F.round(F.avg("gap"), 4).alias("mean_gap"), F.max("gap").alias("max_gap"), F.round(F.percentile("gap", F.lit(0.95)), 4).alias("p95_gap"),
        (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("duration_ms"), F.count("*").alias("frames"), F.coalesce(F.max("gap") > 30000, F.lit(False)).alias("sparse"),
    )


@query("""SELECT source, max(n_chars) FILTER (WHERE place = round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(n_chars) FILTER (WHERE place = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95, round(sum(n_chars) / count(*)::DOUBLE, 6) AS throughput FROM
  (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY source""")
def caption_report(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles: the value at place round((n - 1) p), halves to even."""
    values = views.read(spark, d, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("m"))
    # values with counts, so that a hot source is a histogram and not a list of rows
    h = values.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("n_chars", "m"))).alias("h"), F.sum("m").alias("n"), F.sum(F.col("n_chars") * F.col("m")).alias("chars"))
    at = lambda p: F.aggregate(
        "h",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v")),
        lambda s, e: F.struct((s["seen"] + e["m"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + e["m"] > F.bround((F.col("n") - 1) * F.lit(p))), e["n_chars"]).otherwise(s["v"]).alias("v")),
    )["v"]
    return h.select("source", at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.col("chars") / F.col("n"), 6).alias("throughput"))


@query("""SELECT conv_id, string_agg(t, ' ' ORDER BY turn) AS text, count(*) AS parts FROM (SELECT conv_id, turn, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS t FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id, replace(lower(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))), 'ß', 'ss') ORDER BY turn) = 1) WHERE t <> '' GROUP BY conv_id""")
def distinct_transcript_text(spark: SparkSession, d: str) -> DataFrame:
    return evidence.distinct_text(views.read(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query(with_views("regions", """ SELECT frame_id, count(DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) FILTER (WHERE confidence >= 0.3 AND regexp_matches(text, '[\\p{L}\\p{N}]')) AS kept, count(*) AS total,
  round(least(1, (count(DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) FILTER (WHERE confidence >= 0.3 AND regexp_matches(text, '[\\p{L}\\p{N}]'))) / count(*)::DOUBLE * round(avg(confidence), 12)), 9) AS quality FROM regions GROUP BY frame_id"""))
def ocr_region_quality(spark: SparkSession, d: str) -> DataFrame:
    return evidence.region_quality(views.regions(spark, d), 0.3)


@query("""SELECT bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS failures FROM (SELECT event_type, CASE WHEN value <= 1 THEN 1 WHEN value <= 5 THEN 5 WHEN value <= 10 THEN 10 WHEN value <= 25 THEN 25 WHEN value <= 50 THEN 50
  WHEN value <= 100 THEN 100 WHEN value <= 250 THEN 250 WHEN value <= 500 THEN 500 WHEN value <= 1000 THEN 1000 WHEN value <= 5000 THEN 5000 END AS bucket FROM events) GROUP BY bucket""")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    edges = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 5000)
    bucket = F.coalesce(*[F.when(F.col("value") <= e, F.lit(e)) for e in edges])
    return views.read(spark, d, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("failures"))


@query("SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE n > 1")
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rows of values that are there more than once; the values' digests are counted first."""
    docs = views.read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return docs.join(docs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h").select("doc_id", "n")


@query("""SELECT source, sha256(concat_ws(':', count(*), bit_xor(('0x' || left(h, 15))::BIGINT), sum(('0x' || right(h, 7))::BIGINT))) AS fingerprint, count(*) AS rows
  FROM (SELECT source, sha256(concat_ws(':', doc_id, lang, text)) AS h FROM documents) GROUP BY source""")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a group's rows that does not depend on their order, of sums that are combined before the shuffle."""
    h = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "lang", "text"), 256)
    docs = views.read(spark, d, "documents").select("source", h.alias("h"))
    number = lambda x: F.conv(x, 16, 10).cast("long")
    parts = [F.count("*"), F.bit_xor(number(F.substring("h", 1, 15))), F.sum(number(F.substring("h", 58, 7)))]
    return docs.groupBy("source").agg(F.sha2(F.concat_ws(":", *[x.cast("string") for x in parts]), 256).alias("fingerprint"), F.count("*").alias("rows"))


@query(with_views("frames", " SELECT video_id % 3 AS part, frame_id, row_number() OVER (ORDER BY video_id % 3, video_id, frame_idx) - 1 AS position FROM frames"))
def reduce_groups(spark: SparkSession, d: str) -> DataFrame:
    """Three groups with indexes of their own, checked, and put one after another."""
    place = F.row_number().over(W.partitionBy("part").orderBy("video_id", "frame_idx")) - 1
    f = views.frames(spark, d).withColumn("part", F.col("video_id") % 3).withColumn("embedding_index", place.cast("long"))
    return vector.reduced(f.select("part", "embedding_index", "frame_id", "embedding"), "part").drop("embedding")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT user_id, round(median(value), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(sum(json_extract(props, '$.k')::BIGINT) / sum(value), 6) AS throughput FROM events WHERE event_type = 'click' GROUP BY user_id""")
def probe_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = views.read(spark, d, "events").where("event_type = 'click'").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("user_id").agg(
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("median_ms"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95_ms"), F.round(F.sum("k") / F.sum("value"), 6).alias("throughput")
    )


#: Evidence is the thirty best of the fifty hits that are evaluated; scenes are twenty seconds; constraints are told apart
#: by pairs of times, as they are defined.
SCENES = with_views(_TASKS + " constraints", """, seen AS (SELECT hits.*, task, event, timestamp_ms // 20000 AS scene FROM hits JOIN tasks USING (query_id)), e AS (SELECT * FROM seen WHERE rank <= 30),
  p AS (SELECT task, event, video_id, max(score) AS m FROM e GROUP BY ALL), u AS (SELECT task, event, least(0, min(m)) AS low, max(m) AS high FROM p GROUP BY ALL),
  b AS (SELECT task, video_id, scene, event, max(score) AS best, min(timestamp_ms) AS t0, max(timestamp_ms) AS t1 FROM e GROUP BY ALL),
  s AS (SELECT task, video_id, scene, round(avg(CASE WHEN high <= low THEN 1.0::DOUBLE ELSE least(1, greatest(0, (best - low) / (high - low))) END), 9) AS semantic, count(*) AS matched,
    min(t0) AS start_ms, max(t1) AS end_ms FROM b JOIN u USING (task, event) GROUP BY ALL),
  v AS (SELECT task, video_id, count(DISTINCT event) AS evaluated FROM seen GROUP BY ALL),
  outcome AS (SELECT s.task, s.video_id, s.scene, c.relation, c.subject, c.object,
    CASE WHEN x.n = 0 OR (c.object IS NOT NULL AND y.n = 0) THEN NULL WHEN c.relation = 'AT_END' THEN x.last = s.end_ms ELSE z.held END AS holds
    FROM s JOIN constraints c USING (task),
    LATERAL (SELECT count(*) AS n, max(timestamp_ms) AS last FROM e WHERE e.task = s.task AND e.video_id = s.video_id AND e.scene = s.scene AND e.event = c.subject) x,
    LATERAL (SELECT count(*) AS n FROM e WHERE e.task = s.task AND e.video_id = s.video_id AND e.scene = s.scene AND e.event = c.object) y,
    LATERAL (SELECT coalesce(bool_or(CASE WHEN c.relation = 'BEFORE' THEN i.timestamp_ms <= j.timestamp_ms ELSE abs(i.timestamp_ms - j.timestamp_ms) <= 10000 END), false) AS held FROM e i JOIN e j USING (task, video_id, scene)
      WHERE i.task = s.task AND i.video_id = s.video_id AND i.scene = s.scene AND i.event = c.subject AND j.event = c.object) z),
  told AS (SELECT task, video_id, scene, round(avg(holds::INT), 9) AS related, count(*) - count(holds) AS unknown FROM outcome GROUP BY ALL),
  scenes AS (SELECT task, video_id, scene, start_ms, end_ms, related, coalesce(unknown, 0) AS unknown, semantic, round(matched / evaluated, 9) AS coverage, round(evaluated / 3, 9) AS evaluation,
    round(1.0::DOUBLE / (1 + (end_ms - start_ms) / 10000.0::DOUBLE), 9) AS temporal, round((0.45::DOUBLE * semantic + 0.30::DOUBLE * (matched / evaluated) * (evaluated / 3)
    + 0.15::DOUBLE / (1 + (end_ms - start_ms) / 10000.0::DOUBLE) + coalesce(0.10::DOUBLE * related, 0)) / CASE WHEN related IS NULL THEN 0.9::DOUBLE ELSE 1 END, 12) AS score
    FROM s JOIN v USING (task, video_id) LEFT JOIN told USING (task, video_id, scene)),
  top3 AS (SELECT * FROM scenes QUALIFY row_number() OVER (PARTITION BY task, video_id ORDER BY score DESC, semantic DESC, coverage DESC, evaluation DESC, temporal DESC, start_ms, scene) <= 3),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, semantic DESC, coverage DESC, evaluation DESC, temporal DESC, video_id, start_ms, scene)::INTEGER AS place
    FROM top3 QUALIFY place <= 100)""")


def _scenes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(evidence, scores of its scenes)."""
    seen = task_hits(spark, d).withColumn("scene", F.expr("timestamp_ms div 20000"))
    seen = shared.written(seen.select("task", "event", "video_id", "scene", "frame_id", "timestamp_ms", "score", "rank"), "evidence")
    e = seen.where("rank <= 30").drop("rank")
    return e, evidence.scene_scores(e, seen, views.constraints(spark, d), "task", "event", "scene", 3, 10000)


@query(SCENES + " SELECT * FROM scenes")
def scene_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scenes(spark, d)[1]


@query(SCENES + " SELECT * FROM ordered")
def scene_order(spark: SparkSession, d: str) -> DataFrame:
    """Three scenes of a video, then a hundred over all, by eight keys."""
    return evidence.scene_order(scene_scores(spark, d), "task")


@query(SCENES + """, r AS (SELECT o.task, o.place, o.score AS scene_score, e.frame_id, e.score FROM ordered o JOIN e USING (task, video_id, scene)
    QUALIFY row_number() OVER (PARTITION BY o.task, e.frame_id ORDER BY o.place, e.score DESC) = 1)
  SELECT task, frame_id, scene_score, row_number() OVER (PARTITION BY task ORDER BY place, score DESC, frame_id)::INTEGER AS rank FROM r QUALIFY rank <= 20""")
def scene_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Frames to answer from: those of the best scenes, each scene's by score, a frame once, twenty of a task."""
    e, scenes = _scenes(spark, d)
    ordered = evidence.scene_order(scenes, "task")
    keys = ["task", "video_id", "scene"]
    joined = ordered.select(*keys, "place", F.col("score").alias("scene_score")).join(e.select(*keys, "frame_id", "score"), keys)
    first = joined.groupBy("task", "frame_id").agg(F.min(F.struct("place", (-F.col("score")).alias("less"), "scene_score")).alias("f"))
    rows = first.select("task", "frame_id", "f.*")
    ranked = fusion.top_per(rows, ["task"], [F.col("place"), F.col("less"), F.col("frame_id")], 20)
    return ranked.select("task", "frame_id", "scene_score", "rank")


@query(with_views("frames queries gold hits", """ SELECT query_id, count(*) AS results, round(max(score), 6) AS best, round(avg(score), 6) AS mean, count(g.frame_id) = 0 AS failed
  FROM hits LEFT JOIN gold g USING (query_id, frame_id) GROUP BY query_id"""))
def benchmark_report(spark: SparkSession, d: str) -> DataFrame:
    """The per-query report, written as JSON and CSV, and the queries without a gold frame as a file of failures; the files
    read again."""
    path = shared.shared_path(spark, "report")
    found = shared.written(hits(spark, d).select("query_id", "frame_id", "score"), "found")
    gold = views.gold_of(spark, d, found).withColumn("gold", F.lit(1))
    rows = found.join(gold, ["query_id", "frame_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("results"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"), F.count("gold").alias("found")
    )
    rows = shared.written(rows, "report-rows")
    rows.write.json(f"{path}/json")
    rows.drop("found").write.option("header", True).csv(f"{path}/csv")
    rows.where("found = 0").select("query_id").write.json(f"{path}/failures")
    report = spark.read.schema("query_id long, results long, best double, mean double").option("header", True).csv(f"{path}/csv")
    failures = spark.read.schema("query_id long").json(f"{path}/failures").withColumn("failed", F.lit(True))
    return report.join(failures, "query_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


@query(with_views("timeline", " SELECT video_id, count(*) AS frames, count(DISTINCT event_type) AS kinds, max(motion_score) AS peak, arg_max(frame_id, (motion_score, -frame_id)) AS peak_frame FROM timeline GROUP BY video_id"))
def video_inventory(spark: SparkSession, d: str) -> DataFrame:
    best = F.max(F.struct("motion_score", (-F.col("frame_id")).alias("less")))
    return views.timeline(spark, d).groupBy("video_id").agg(
        F.count("*").alias("frames"), F.count_distinct("event_type").alias("kinds"), F.max("motion_score").alias("peak"), (-best["less"]).alias("peak_frame")
    )
