"""Queries of scans, filters, lookups, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import fusion, joins, vector
from ..sources import shared, views
from ..sources.views import with_views
from .registry import query

# ---- scans and their contracts


@query(with_views("frames", " SELECT count(*) AS rows, count(*) - count(DISTINCT frame_id) AS repeated_ids, count(*) FILTER (WHERE frame_idx < 0 OR timestamp_ms < 0) AS invalid FROM frames"))
def scan_frames(spark: SparkSession, d: str) -> DataFrame:
    bad = (F.col("frame_idx") < 0) | (F.col("timestamp_ms") < 0)
    return views.frames(spark, d).agg(
        F.count("*").alias("rows"), (F.count("*") - F.countDistinct("frame_id")).alias("repeated_ids"), F.sum(bad.cast("long")).alias("invalid")
    )


@query("SELECT doc_id, source FROM documents WHERE n_chars > 2000")
def scan_projection(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "documents").where("n_chars > 2000").select("doc_id", "source")


@query(with_views("frames", """ SELECT video_id::VARCHAR AS video_id, count(*) AS rows, max(keyframe_order) - count(*) + min(keyframe_order) - 1 AS gaps,
  count(DISTINCT CASE WHEN frame_id % 31 = 0 THEN 30.0 ELSE 25.0 END) AS rates, count(*) FILTER (WHERE frame_id % 23 = 0) AS negative,
  max(round_even(timestamp_ms / 1000.0::DOUBLE * 1000, 0))::BIGINT AS last_ms FROM frames WHERE frame_id % 17 <> 0 GROUP BY 1"""))
def scan_mapping_csv(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file for each video (n, pts_time, fps, frame_idx), strictly read; its name is the video.  What breaks the
    contract is counted: n should run 1..N, with one rate and no negative index."""
    path, i = shared.shared_path(spark, "mapping"), F.col("frame_id")
    rows = views.frames(spark, d).where(i % 17 != 0).select(
        "video_id", F.col("keyframe_order").alias("n"), (F.col("timestamp_ms") / 1000.0).alias("pts_time"),
        F.when(i % 31 == 0, 30.0).otherwise(25.0).alias("fps"), F.when(i % 23 == 0, -1).otherwise(F.col("frame_idx")).alias("frame_idx"),
    )
    rows.repartition("video_id").sortWithinPartitions("video_id", "n").write.partitionBy("video_id").option("header", True).csv(path)
    schema = "n long, pts_time double, fps double, frame_idx long"
    got = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).csv(path)
    got = got.withColumn("video_id", F.regexp_extract(F.col("_metadata.file_path"), "video_id=([^/]+)/", 1))
    return got.groupBy("video_id").agg(
        F.count("*").alias("rows"),
        (F.max("n") - F.count("*") + F.min("n") - 1).alias("gaps"),
        F.count_distinct("fps").alias("rates"),
        F.sum((F.col("frame_idx") < 0).cast("long")).alias("negative"),
        F.max(F.bround(F.col("pts_time") * 1000).cast("long")).alias("last_ms"),
    )


@query(with_views("detections", " SELECT video_id, day, label, confidence FROM detections"))
def scan_object_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON text for each frame with parallel arrays, scores as strings; parsed, zipped and exploded."""
    det = views.detections(spark, d).groupBy("video_id", "day").agg(F.sort_array(F.collect_list(F.struct("detection_id", "label", "confidence"))).alias("x"))
    text = det.select("video_id", "day", F.to_json(F.struct(F.col("x.label").alias("labels"), F.col("x.confidence").cast("array<string>").alias("scores"))).alias("j"))
    parsed = text.select("video_id", "day", F.from_json("j", "labels array<string>, scores array<string>", {"mode": "PERMISSIVE"}).alias("p"))
    each = parsed.select("video_id", "day", F.explode(F.arrays_zip("p.labels", "p.scores")).alias("e"))
    return each.select("video_id", "day", F.col("e.labels").alias("label"), F.col("e.scores").try_cast("double").alias("confidence"))


@query(with_views("segments", " SELECT count(*) AS rows, count(DISTINCT segment_id) AS ids, count(*) FILTER (WHERE end_ms <= start_ms) AS empty FROM segments"))
def scan_recursive_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = shared.shared_path(spark, "segments")
    views.segments(spark, d).withColumn("bucket", F.col("video_id") % 4).write.partitionBy("bucket").parquet(path)
    got = spark.read.option("recursiveFileLookup", True).parquet(path)
    return got.agg(F.count("*").alias("rows"), F.countDistinct("segment_id").alias("ids"), F.sum((F.col("end_ms") <= F.col("start_ms")).cast("long")).alias("empty"))


@query("SELECT item_id AS query_id, text AS query, 0::BIGINT AS tolerance_ms FROM benchmark WHERE length(trim(text)) > 0")
def scan_evaluation_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = shared.shared_path(spark, "evaluation")
    views.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).write.json(path)
    got = spark.read.schema("query_id long, query string, tolerance_ms long").json(path)
    return got.where(F.length(F.trim("query")) > 0).withColumn("tolerance_ms", F.coalesce("tolerance_ms", F.lit(0).cast("long")))


@query("""SELECT count(*) FILTER (WHERE o.doc_id IS NULL) AS extra, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE o.n <> l.n) AS wrong_size, count(*) FILTER (WHERE o.n = l.n AND o.h <> l.h) AS wrong_checksum
  FROM (SELECT doc_id, length(text) AS n, md5(text) AS h FROM documents) o FULL JOIN
  (SELECT doc_id, n_chars + (doc_id % 97 = 0)::INT AS n, md5(text || CASE WHEN doc_id % 89 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 53 <> 0) l ON o.doc_id = l.doc_id""")
def verify_inventory(spark: SparkSession, d: str) -> DataFrame:
    """A listing against its inventory: missing, extra, of a wrong size, of another checksum."""
    docs, i = views.read(spark, d, "documents"), F.col("doc_id")
    have = docs.select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("h"), F.lit(1).alias("here"))
    checksum = F.md5(F.concat("text", F.when(i % 89 == 0, "x").otherwise("")))
    told = docs.where("doc_id % 53 <> 0").select("doc_id", (F.col("n_chars") + (i % 97 == 0).cast("int")).alias("m"), checksum.alias("c"), F.lit(1).alias("told"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    same = F.col("n") == F.col("m")
    return have.join(told, "doc_id", "full").agg(
        n(F.col("here").isNull()).alias("extra"), n(F.col("told").isNull()).alias("missing"), n(~same).alias("wrong_size"), n(same & (F.col("h") != F.col("c"))).alias("wrong_checksum")
    )


# ---- filters and lookups


def frame_filter(df: DataFrame, videos: list | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Frames of some videos (none given: all) with start <= time <= end."""
    df = df.where(F.col("video_id").isin(videos)) if videos else df
    df = df.where(F.col("timestamp_ms") >= start) if start is not None else df
    return df.where(F.col("timestamp_ms") <= end) if end is not None else df


def segment_filter(df: DataFrame, start: int, end: int) -> DataFrame:
    """Segments that overlap the half-open [start, end); an empty request has none."""
    return df.where((F.col("end_ms") > start) & (F.col("start_ms") < end) & F.lit(end > start))


@query(with_views("timeline", " SELECT frame_id, video_id, timestamp_ms FROM timeline WHERE video_id IN (3, 7, 11) AND timestamp_ms BETWEEN 60000 AND 240000"))
def filter_frames(spark: SparkSession, d: str) -> DataFrame:
    return frame_filter(views.timeline(spark, d), [3, 7, 11], 60000, 240000).select("frame_id", "video_id", "timestamp_ms")


@query(with_views("frames queries", """, scored AS (SELECT query_id, frame_id, round(list_inner_product(query::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM queries, frames
  WHERE video_id IN (1, 2, 3) AND timestamp_ms BETWEEN 0 AND 60000)
  SELECT query_id, frame_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM scored) WHERE rank <= 5"""))
def filtered_knn(spark: SparkSession, d: str) -> DataFrame:
    """The filter reaches the scan before any vector is scored."""
    corpus = frame_filter(views.frames(spark, d), [1, 2, 3], 0, 60000).select("frame_id", "embedding")
    return vector.knn_join(views.queries(spark, d), corpus, 5)


@query(with_views("segments", " SELECT segment_id, start_ms, end_ms FROM segments WHERE end_ms > 5000 AND start_ms < 30000"))
def filter_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment_filter(views.segments(spark, d), 5000, 30000).select("segment_id", "start_ms", "end_ms")


@query(with_views("frames queries hits", " SELECT query_id, frame_id, score, rank::INTEGER AS rank FROM hits WHERE rank <= 20 AND score >= 0.2"))
def min_score_after_topk(spark: SparkSession, d: str) -> DataFrame:
    """The least score is asked for after the k best are chosen, so fewer than k may be left."""
    return hits(spark, d).where("rank <= 20").where("score >= 0.2").select("query_id", "frame_id", "score", "rank")


@query(with_views("evidence", """ SELECT b.frame_id, CASE WHEN c.status = 'completed' AND trim(c.caption_text) <> '' THEN c.caption_text END AS caption,
  CASE WHEN o.quality >= 0.5 AND trim(o.ocr_text) <> '' THEN o.ocr_text END AS ocr, CASE WHEN x.object_count > 0 AND trim(x.object_summary) <> '' THEN x.object_summary END AS objects
  FROM base b LEFT JOIN captions c USING (frame_id) LEFT JOIN ocr o USING (frame_id) LEFT JOIN objects x USING (frame_id)"""))
def usable_evidence(spark: SparkSession, d: str) -> DataFrame:
    base, captions, ocr, objects = views.evidence(spark, d)
    return base.join(captions, "frame_id", "left").join(ocr, "frame_id", "left").join(objects, "frame_id", "left").select(
        "frame_id",
        F.when((F.col("status") == "completed") & (F.trim("caption_text") != ""), F.col("caption_text")).alias("caption"),
        F.when((F.col("quality") >= 0.5) & (F.trim("ocr_text") != ""), F.col("ocr_text")).alias("ocr"),
        F.when((F.col("object_count") > 0) & (F.trim("object_summary") != ""), F.col("object_summary")).alias("objects"),
    )


@query("""WITH prior AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS status, 'v' || toxic AS version, md5(text) || CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE '' END AS lineage
    FROM labels JOIN documents USING (doc_id)), p AS (SELECT doc_id, count(*) AS n, max(status) AS status, max(version) AS version, max(lineage) AS lineage FROM prior GROUP BY doc_id)
  SELECT d.doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN status <> 'completed' THEN 'failed' WHEN version <> 'v0' THEN 'version' WHEN lineage <> md5(text) THEN 'lineage' ELSE 'reuse' END AS decision
  FROM documents d LEFT JOIN p USING (doc_id)""")
def resume_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Earlier work is reused where exactly one earlier row is complete, of the version asked for, and made of the same
    input; else why not."""
    docs = views.read(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    stale = F.when(F.col("doc_id") % 13 == 0, "x").otherwise("")
    prior = views.read(spark, d, "labels").join(docs, "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("quality") == 1, "completed").otherwise("failed")).alias("status"),
        F.max(F.concat(F.lit("v"), F.col("toxic").cast("string"))).alias("version"),
        F.max(F.concat("digest", stale)).alias("lineage"),
    )
    why = (
        F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("status") != "completed", "failed")
        .when(F.col("version") != "v0", "version").when(F.col("lineage") != F.col("digest"), "lineage").otherwise("reuse")
    )
    return docs.join(prior, "doc_id", "left").select("doc_id", why.alias("decision"))


@query(with_views("segments", " SELECT segment_id, video_id, start_ms FROM segments WHERE start_ms <= 9000 AND 9000 < end_ms"))
def transcript_at(spark: SparkSession, d: str) -> DataFrame:
    return views.segments(spark, d).where("start_ms <= 9000 and 9000 < end_ms").select("segment_id", "video_id", "start_ms")


@query(with_views("frames", " SELECT i.position::INTEGER AS position, f.frame_id, f.video_id FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 19)) i(position, id) JOIN frames f ON f.frame_id = i.id"))
def lookup_many(spark: SparkSession, d: str) -> DataFrame:
    return joins.in_order_of([7, 3, 7, 19], views.frames(spark, d), "frame_id").select("position", "frame_id", "video_id")


@query(with_views("timeline", """ SELECT video_id, count(*) AS known FROM timeline t WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = t.video_id AND e.event_id % 50 = t.frame_idx) GROUP BY video_id"""))
def membership(spark: SparkSession, d: str) -> DataFrame:
    """Which (video, index) pairs exist: a semi-join."""
    known = views.read(spark, d, "events").select(F.col("user_id").alias("video_id"), (F.col("event_id") % 50).alias("frame_idx"))
    return views.timeline(spark, d).join(known, ["video_id", "frame_idx"], "left_semi").groupBy("video_id").agg(F.count("*").alias("known"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) INTERSECT SELECT DISTINCT user_id FROM events WHERE value > 50")
def filter_intersection(spark: SparkSession, d: str) -> DataFrame:
    events = views.read(spark, d, "events")
    least = events.agg(F.min("event_type")).first()[0]
    return events.where(F.col("event_type") == least).select("user_id").intersect(events.where("value > 50").select("user_id"))


@query(with_views("frames", """, p AS (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id::VARCHAR) AS place FROM frames),
  q AS (SELECT video_id, keyframe_order, row_number() OVER (PARTITION BY video_id ORDER BY keyframe_order) AS place FROM frames)
  SELECT video_id, frame_id, keyframe_order, place::INTEGER AS place FROM p FULL JOIN q USING (video_id, place)"""))
def path_projection(spark: SparkSession, d: str) -> DataFrame:
    """Files by name against key frames by order: the n-th with the n-th."""
    f = views.frames(spark, d)
    files = f.select("video_id", "frame_id", F.col("frame_id").cast("string").alias("name"))
    return joins.rank_pairs(files, f.select("video_id", "keyframe_order"), "video_id", "name", "keyframe_order").drop("name")


@query(with_views("frames", """ SELECT video_id, count(*) AS rows, count(*) FILTER (WHERE frame_idx <> frame_id % 100) AS idx_changed, count(*) FILTER (WHERE timestamp_ms <> 40 * frame_id) AS time_changed FROM frames GROUP BY video_id"""))
def coordinate_override(spark: SparkSession, d: str) -> DataFrame:
    """Mapping coordinates replace the source's; how many differ."""
    f = views.frames(spark, d).withColumns({"src_idx": F.col("frame_id") % 100, "src_ms": F.col("frame_id") * 40})
    n = lambda c: F.sum(c.cast("long"))
    return f.groupBy("video_id").agg(F.count("*").alias("rows"), n(F.col("frame_idx") != F.col("src_idx")).alias("idx_changed"), n(F.col("timestamp_ms") != F.col("src_ms")).alias("time_changed"))


@query(with_views("regions", " SELECT frame_id, region_order AS line, text AS content, confidence AS score FROM regions"))
def legacy_projection(spark: SparkSession, d: str) -> DataFrame:
    r = views.regions(spark, d)
    return r.select("frame_id", F.col("region_order").alias("line"), F.col("text").alias("content"), F.col("confidence").alias("score"))


@query(with_views("frames queries hits", """ SELECT query_id, rank::INTEGER AS rank, frame_id, coalesce(CASE WHEN rank % 5 = 0 THEN NULL ELSE score END, CASE WHEN rank % 10 = 0 THEN NULL ELSE 0.5::DOUBLE END, 0.0::DOUBLE) AS shown_score,
  '/frames/' || frame_id || '/image?video=' || video_id AS image_url FROM hits WHERE rank <= 20"""))
def materialise_results(spark: SparkSession, d: str) -> DataFrame:
    """Response rows: the first score there is, and addresses."""
    h = hits(spark, d).where("rank <= 20")
    shown = F.coalesce(F.when(F.col("rank") % 5 != 0, F.col("score")), F.when(F.col("rank") % 10 != 0, F.lit(0.5)), F.lit(0.0))
    url = F.concat(F.lit("/frames/"), F.url_encode(F.col("frame_id").cast("string")), F.lit("/image?video="), F.col("video_id").cast("string"))
    return h.select("query_id", "rank", "frame_id", shown.alias("shown_score"), url.alias("image_url"))


@query(with_views("segments", " SELECT segment_id, row_number() OVER (ORDER BY video_id, segment_index) - 1 AS position FROM segments WHERE status = 'completed' AND trim(text) <> ''"))
def indexable_segments(spark: SparkSession, d: str) -> DataFrame:
    """Completed, non-blank segments with dense positions: counts by video, then places within it."""
    s = views.segments(spark, d).where("status = 'completed' and trim(text) <> ''")
    before = W.orderBy("video_id").rowsBetween(W.unboundedPreceding, -1)  # a row for each video
    offsets = s.groupBy("video_id").agg(F.count("*").alias("n")).select("video_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("video_id").orderBy("segment_index"))
    return s.withColumn("place", place).join(offsets, "video_id").select("segment_id", (F.col("before") + F.col("place") - 1).alias("position"))


# ---- joins


def hits(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The k best frames of each query vector."""
    return vector.knn_join(views.queries(spark, d), views.frames(spark, d).drop("keyframe_order"), k)


@query(with_views("frames", """ SELECT f.frame_id, f.video_id, f.keyframe_order, CASE WHEN frame_id % 9 <> 0 THEN round_even((f.keyframe_order - 1) * 2.0005::DOUBLE * 1000, 0)::BIGINT ELSE -1 END AS timestamp_ms FROM frames f"""))
def mapping_join(spark: SparkSession, d: str) -> DataFrame:
    """Frames with their mapping; seconds become milliseconds, halves to even; -1 where there is none."""
    f = views.frames(spark, d)
    mapping = f.where("frame_id % 9 <> 0").select("video_id", "keyframe_order", ((F.col("keyframe_order") - 1) * F.lit(2.0005)).alias("pts"))
    joined = f.select("frame_id", "video_id", "keyframe_order").join(mapping, ["video_id", "keyframe_order"], "left")
    return joined.select("frame_id", "video_id", "keyframe_order", F.coalesce(F.bround(F.col("pts") * 1000).cast("long"), F.lit(-1)).alias("timestamp_ms"))


@query("""SELECT * FROM (SELECT 'unmatched' AS contract, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
  UNION ALL SELECT 'unused', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)
  UNION ALL SELECT 'left_repeated', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
  UNION ALL SELECT 'right_repeated', count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1))""")
def one_to_one_contract(spark: SparkSession, d: str) -> DataFrame:
    return joins.one_to_one(views.read(spark, d, "documents").select("doc_id"), views.read(spark, d, "labels").select("doc_id"), ["doc_id"])


@query("(SELECT doc_id AS id, 'only_documents' AS side FROM documents EXCEPT SELECT doc_id, 'only_documents' FROM labels) UNION ALL (SELECT page_id, 'only_pages' FROM pages EXCEPT SELECT doc_id, 'only_pages' FROM documents)")
def key_set_difference(spark: SparkSession, d: str) -> DataFrame:
    """The symmetric difference of key sets, by side."""
    docs, labels, pages = (views.read(spark, d, t) for t in ("documents", "labels", "pages"))
    ids = docs.select(F.col("doc_id").alias("id"))
    a = ids.subtract(labels.select("doc_id")).withColumn("side", F.lit("only_documents"))
    return a.unionByName(pages.select(F.col("page_id").alias("id")).subtract(ids).withColumn("side", F.lit("only_pages")))


@query(with_views("evidence", """ SELECT b.frame_id, c.caption_text, o.ocr_text, j.object_summary, c.frame_id IS NOT NULL AS caption_available, coalesce(o.quality, 0) AS ocr_quality,
  coalesce(j.object_count, 0) AS object_count FROM base b LEFT JOIN captions c USING (frame_id) LEFT JOIN ocr o USING (frame_id) LEFT JOIN objects j USING (frame_id)"""))
def frame_context_join(spark: SparkSession, d: str) -> DataFrame:
    base, captions, ocr, objects = views.evidence(spark, d)
    joined = base.join(captions.withColumn("have", F.lit(True)), "frame_id", "left").join(ocr, "frame_id", "left").join(objects, "frame_id", "left")
    return joined.select(
        "frame_id", "caption_text", "ocr_text", "object_summary", F.coalesce("have", F.lit(False)).alias("caption_available"),
        F.coalesce("quality", F.lit(0.0)).alias("ocr_quality"), F.coalesce("object_count", F.lit(0)).alias("object_count"),
    )


@query(with_views("evidence", " SELECT c.frame_id FROM ocr c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.frame_id = c.frame_id AND b.n_chars > 300)"))
def unknown_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of frames that the corpus lacks: an anti-join that should be empty."""
    base, _, ocr, _ = views.evidence(spark, d)
    return ocr.join(base.where("n_chars > 300"), "frame_id", "left_anti").select("frame_id")


OVERLAP = with_views("timeline segments", """, w AS (SELECT frame_id, video_id, greatest(0, timestamp_ms - 1500) AS a, timestamp_ms + 1501 AS b FROM timeline)""")


@query(OVERLAP + " SELECT w.frame_id, s.segment_id FROM w JOIN segments s ON s.video_id = w.video_id AND s.status = 'completed' AND s.start_ms < w.b AND s.end_ms > w.a")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return frame_segments(spark, d).select("frame_id", "segment_id")


def frame_segments(spark: SparkSession, d: str) -> DataFrame:
    """Frames with the completed segments that overlap [max(0, t - 1500), t + 1501)."""
    t = views.timeline(spark, d).select("frame_id", "video_id", F.greatest(F.lit(0), F.col("timestamp_ms") - 1500).alias("l_start"), (F.col("timestamp_ms") + 1501).alias("l_end"))
    s = views.segments(spark, d).where("status = 'completed'").withColumnsRenamed({"start_ms": "r_start", "end_ms": "r_end"})
    return joins.overlap_join(t, s, "video_id")


@query(OVERLAP + """, m AS (SELECT w.frame_id, s.segment_index, s.text FROM w JOIN segments s ON s.video_id = w.video_id AND s.status = 'completed' AND s.start_ms < w.b AND s.end_ms > w.a)
  SELECT t.frame_id, g.text, coalesce(g.n, 0) AS segments FROM timeline t LEFT JOIN (SELECT frame_id, string_agg(text, ' ' ORDER BY segment_index) AS text, count(*) AS n FROM m GROUP BY frame_id) g USING (frame_id)""")
def transcript_view(spark: SparkSession, d: str) -> DataFrame:
    """Every frame with the text of its window, null where nothing was said."""
    met = frame_segments(spark, d).groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("segment_index", "text"))).alias("x"))
    texts = met.select("frame_id", F.array_join("x.text", " ").alias("text"), F.size("x").cast("long").alias("segments"))
    return views.timeline(spark, d).select("frame_id").join(texts, "frame_id", "left").withColumn("segments", F.coalesce("segments", F.lit(0).cast("long")))


@query(with_views("timeline segments", """, m AS (SELECT s.video_id, s.segment_id, t.frame_id, t.frame_idx, t.timestamp_ms, abs(t.timestamp_ms - (s.start_ms + s.end_ms) // 2) AS distance,
  t.timestamp_ms >= s.start_ms AND t.timestamp_ms < s.end_ms AS inside FROM segments s JOIN timeline t USING (video_id))
  SELECT video_id, segment_id, frame_id, distance, inside, timestamp_ms FROM m WHERE inside OR distance <= 4000
  QUALIFY row_number() OVER (PARTITION BY video_id, segment_id ORDER BY NOT inside, distance, timestamp_ms, frame_idx, frame_id) = 1"""))
def nearest_frame_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.nearest_frame(views.segments(spark, d), views.timeline(spark, d), 4000)


@query(with_views("timeline", " SELECT a.frame_id, b.frame_id AS other_id, b.timestamp_ms - a.timestamp_ms AS gap_ms FROM timeline a JOIN timeline b ON a.video_id = b.video_id AND abs(a.timestamp_ms - b.timestamp_ms) <= 800 AND a.frame_id <> b.frame_id"))
def neighbour_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.neighbours(views.timeline(spark, d), 800)


@query(with_views("segments turns", """, o AS (SELECT s.segment_id, t.speaker, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS overlap_ms FROM segments s JOIN turns t USING (video_id))
  SELECT s.segment_id, b.speaker, b.overlap_ms FROM segments s LEFT JOIN (SELECT * FROM o WHERE overlap_ms > 0 QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY overlap_ms DESC, speaker DESC) = 1) b USING (segment_id)"""))
def speaker_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.speaker_of(views.segments(spark, d), views.turns(spark, d))


@query(with_views("frames queries hits", " SELECT query_id, frame_id, score, rank::INTEGER AS rank FROM hits WHERE rank <= 10"))
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d, 10).select("query_id", "frame_id", "score", "rank")


@query(with_views("frames queries hits", " SELECT query_id, frame_id, score, rank::INTEGER AS rank FROM hits WHERE rank <= 10"))
def knn_topk_expression(spark: SparkSession, d: str) -> DataFrame:
    return vector.knn_expression(views.queries(spark, d), views.frames(spark, d).select("frame_id", "embedding"), 10)


@query(with_views("frames queries hits", """, v AS (SELECT DISTINCT query_id, video_id FROM hits WHERE rank <= 10)
  SELECT query_id, f.frame_id, round(list_inner_product(query::DOUBLE[], f.embedding::DOUBLE[]), 6) AS score FROM queries JOIN v USING (query_id) JOIN frames f USING (video_id)"""))
def score_subset(spark: SparkSession, d: str) -> DataFrame:
    """Every query against every frame of the videos that its ten best hits name."""
    videos = hits(spark, d, 10).select("query_id", "video_id").distinct()
    corpus = views.frames(spark, d).select("video_id", "frame_id", "embedding")
    return vector.scored_within(views.queries(spark, d), corpus, videos).select("query_id", "frame_id", "score")


@query(with_views("frames queries hits text_hits", """, r AS (SELECT query_id, 'visual' AS source, frame_id, rank FROM hits WHERE rank <= 30 UNION ALL
  SELECT query_id, 'text', frame_id, rank FROM text_hits)
  SELECT query_id, frame_id, array_to_string(list(source ORDER BY source), ',') AS sources, array_to_string(list(rank ORDER BY source), ',') AS ranks, count(*) > count(DISTINCT source) AS repeated FROM r GROUP BY ALL"""))
def modality_union_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = joins.union_merge(two_sources(spark, d))
    return merged.withColumns({"sources": F.array_join("sources", ","), "ranks": F.array_join(F.col("ranks").cast("array<string>"), ",")})


def text_hits(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """The k best frames of each query by the text part of their vectors."""
    corpus = views.text_part(views.frames(spark, d).select("frame_id", "embedding"), "embedding")
    return vector.knn_join(views.text_part(views.queries(spark, d), "query"), corpus, k)


def two_sources(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of two searches: by the whole vectors (30 frames a query), and by their text part (20)."""
    return shared.written(fusion.union_sources({"visual": hits(spark, d, 30), "text": text_hits(spark, d)}), "sources")


FUSED = with_views("frames queries hits text_hits", """, ranked AS (SELECT query_id, 'visual' AS source, frame_id, rank FROM hits WHERE rank <= 30 UNION ALL
  SELECT query_id, 'text', frame_id, rank FROM text_hits),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, best_rank, frame_id) AS rank FROM (SELECT query_id, frame_id,
  round(sum((CASE source WHEN 'visual' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) / (60 + rank)), 9) AS fusion_score, min(rank) AS best_rank, count(*) AS sources FROM ranked GROUP BY ALL))""")


@query(FUSED + " SELECT query_id, frame_id, fusion_score, best_rank::INTEGER AS best_rank, sources, rank::INTEGER AS rank FROM fused WHERE rank <= 25")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank(two_sources(spark, d), {"visual": 1.0, "text": 0.5}, top=25)


@query(with_views("frames queries hits", """ SELECT query_id, frame_id, round(1.5::DOUBLE / (60 + rank), 9) AS fusion_score, rank::INTEGER AS rank FROM hits WHERE rank <= 10"""))
def rrf_source_lost(spark: SparkSession, d: str) -> DataFrame:
    """One of two sources has failed, one that is not required: the other's weight is scaled to the sum of both."""
    ranked = two_sources(spark, d).where("source = 'visual' and rank <= 10")
    weights = fusion.active_weights({"visual": 1.0, "text": 0.5}, {"visual"}, required={"visual"})
    return fusion.reciprocal_rank(ranked, weights).select("query_id", "frame_id", "fusion_score", "rank")


@query(with_views("frames queries hits", " SELECT h.query_id, h.frame_id, f.video_id, f.frame_idx, h.frame_id % 7 = 0 AS conflict FROM hits h JOIN frames f USING (frame_id) WHERE h.rank <= 15"))
def candidate_lookup(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d, 15).select("query_id", "frame_id", (F.col("timestamp_ms") + (F.col("frame_id") % 7 == 0).cast("int")).alias("told"))
    f = views.frames(spark, d).select("frame_id", "video_id", "frame_idx", "timestamp_ms")
    return h.join(f, "frame_id").select("query_id", "frame_id", "video_id", "frame_idx", (F.col("told") != F.col("timestamp_ms")).alias("conflict"))


@query(with_views("detections", """ SELECT video_id, day, string_agg(label, ',' ORDER BY detection_id) AS labels, count(*) AS n FROM detections GROUP BY ALL"""))
def parent_child_join(spark: SparkSession, d: str) -> DataFrame:
    """Frames with their detections in order."""
    det = views.detections(spark, d)
    parents = det.select("video_id", "day").distinct()
    child = det.groupBy("video_id", "day").agg(F.sort_array(F.collect_list(F.struct("detection_id", "label"))).alias("x"))
    return parents.join(child, ["video_id", "day"]).select("video_id", "day", F.array_join("x.label", ",").alias("labels"), F.size("x").cast("long").alias("n"))


@query(with_views("frames", " SELECT count(*) AS rows, count(*) FILTER (WHERE f.frame_id % 13 = 0) AS missing, count(*) FILTER (WHERE f.frame_id % 13 <> 0 AND f.frame_id % 11 = 0) AS other_video FROM frames f"))
def index_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Frames against an index that lacks some and holds others under another video."""
    f, e = views.frames(spark, d), views.read(spark, d, "embeddings").where("vec_id % 13 <> 0")
    e = e.select("vec_id", (F.col("label") + (F.col("vec_id") % 11 == 0).cast("int")).alias("label"))
    joined = f.join(e, f.frame_id == e.vec_id, "left")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    other = F.col("video_id") % 10 != F.col("label")
    return joined.agg(F.count("*").alias("rows"), n(F.col("label").isNull()).alias("missing"), n(other).alias("other_video"))


@query(with_views("timeline", " SELECT video_id, count(*) AS n FROM timeline WHERE video_id IN (SELECT user_id FROM events WHERE value > 99) GROUP BY video_id"))
def evidence_semi_join(spark: SparkSession, d: str) -> DataFrame:
    chosen = views.read(spark, d, "events").where("value > 99").select(F.col("user_id").alias("video_id")).distinct()
    return views.timeline(spark, d).join(chosen, "video_id", "left_semi").groupBy("video_id").agg(F.count("*").alias("n"))


# ---- set operations


@query("SELECT user_id, array_to_string(list(event_type ORDER BY first), ',') AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values in the order of their first appearance."""
    first = views.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    listed = first.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("first", "event_type"))).alias("x"))
    return listed.select("user_id", F.array_join("x.event_type", ",").alias("kinds"))


@query("SELECT 'documents' AS kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'benchmark', count(*), sum(length(text))::BIGINT FROM benchmark UNION ALL SELECT 'conversations', count(*), sum(length(text))::BIGINT FROM conversations")
def union_all_tables(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("documents", "benchmark", "conversations"):
        rows = views.read(spark, d, t).select(F.lit(t).alias("kind"), F.length("text").cast("long").alias("c"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


@query(with_views("frames queries gold hits", " SELECT query_id, count(*) AS gold_found FROM hits JOIN gold USING (query_id, frame_id) WHERE rank <= 20 GROUP BY query_id"))
def gold_intersection(spark: SparkSession, d: str) -> DataFrame:
    found = views.gold_of(spark, d, hits(spark, d, 20))
    return found.groupBy("query_id").agg(F.count("*").alias("gold_found"))


@query("SELECT u.user_id, k.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) k EXCEPT SELECT user_id, event_type FROM events WHERE value > 40")
def not_yet_evaluated(spark: SparkSession, d: str) -> DataFrame:
    """The kinds each user has not been evaluated for: all kinds less those seen."""
    events = views.read(spark, d, "events")
    wanted = joins.every_pair(events.select("user_id").distinct(), events.select("event_type").distinct())
    return wanted.join(events.where("value > 40"), ["user_id", "event_type"], "left_anti")


@query("SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS unknown_orders, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS empty_orders")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    items, orders = views.read(spark, d, "lineitem"), views.read(spark, d, "orders")
    sides = items.select(F.col("l_orderkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(orders.select(F.col("o_orderkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = sides.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.sum((F.col("b") == 0).cast("long")).alias("unknown_orders"), F.sum((F.col("a") == 0).cast("long")).alias("empty_orders"))
