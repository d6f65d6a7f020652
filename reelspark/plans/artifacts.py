"""Queries of artifacts: vector bundles with postings, builds in shards, typed evidence and the builders that make it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import builds, shared, typed, vectors, views
from ..sources.views import with_views
from .registry import query


def _bundle(spark: SparkSession, d: str) -> vectors.Bundle:
    root = shared.shared_path(spark, "vectors")
    vectors.save(views.frames(spark, d), root, "v1", "given", file_rows=64)
    return vectors.load(spark, root)


@query(with_views("frames queries", """, scored AS (SELECT query_id, frame_id, round(list_inner_product(query::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM queries, frames
  WHERE video_id IN (1, 2, 3, 12) AND timestamp_ms BETWEEN 2000 AND 60000)
  SELECT query_id, frame_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM scored) WHERE rank <= 5"""))
def bundle_search(spark: SparkSession, d: str) -> DataFrame:
    """A search in a published bundle, among the videos whose files its postings name."""
    return _bundle(spark, d).search(views.queries(spark, d), 5, [1, 2, 3, 12], 2000, 60000).select("query_id", "frame_id", "score", "rank")


@query(with_views("frames", """, p AS (SELECT video_id, row_number() OVER (ORDER BY video_id, timestamp_ms, frame_id) - 1 AS position FROM frames)
  SELECT video_id, min(position) AS first, count(*) AS length FROM p GROUP BY video_id"""))
def bundle_postings(spark: SparkSession, d: str) -> DataFrame:
    return _bundle(spark, d).postings.select("video_id", "first", "length")


def _parsed(rows: list[dict]) -> list[dict]:
    """A port that fails where JSON does not parse."""
    import json

    return [{"k": int(json.loads(r["props"])["k"])} for r in rows]


_SHARD, _WAVE = 1000, 4
_BROKEN = "CASE WHEN event_id % 10 = 0 THEN 'x' || props ELSE props END"


@query(f"""WITH p AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // {_SHARD} AS shard FROM events), s AS (SELECT shard, count(*) FILTER (WHERE event_id % 4000 = 0) > 0 AS mended FROM p GROUP BY shard),
  n AS (SELECT count(*) AS shards, least({_WAVE}, count(*)) AS first, count(*) FILTER (WHERE mended) AS again FROM s), e AS (SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 10 = 0) AS broken, count(*) FILTER (WHERE event_id % 4000 = 0) AS mended FROM events)
  SELECT 1 AS run, shards, first AS made, 0::BIGINT AS reused, CASE WHEN first = shards THEN rows - broken END AS completed, CASE WHEN first = shards THEN broken END AS failed FROM n, e
  UNION ALL SELECT 2, shards, shards - first, first, rows - broken, broken FROM n, e UNION ALL SELECT 3, shards, again, shards - again, rows - broken + mended, broken - mended FROM n, e""")
def evidence_build(spark: SparkSession, d: str) -> DataFrame:
    """An artifact built in three runs: the first ends after one wave of shards, the second makes the rest, the third finds
    some rows mended and makes their shards anew.  Rows that fail are failures of their shard."""
    root, e = shared.shared_path(spark, "build"), views.read(spark, d, "events").select("event_id", "props")
    broken = e.withColumn("props", F.expr(_BROKEN))
    mended = e.withColumn("props", F.expr(f"CASE WHEN event_id % 4000 = 0 THEN props ELSE {_BROKEN} END"))
    out = []
    for run, (rows, waves) in enumerate([(broken, 1), (broken, None), (mended, None)], 1):
        state = builds.build(rows, "event_id", _parsed, "k long", root, size=_SHARD, wave=_WAVE, most_waves=waves)
        out.append((run, *(state.get(c) for c in ("shards", "made", "reused", "completed", "failed"))))
    return spark.createDataFrame(out, "run int, shards long, made long, reused long, completed long, failed long")


@query(f"""SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k, CASE WHEN event_id % 10 = 0 THEN 'JSONDecodeError' END AS error FROM events""")
def resume_shards(spark: SparkSession, d: str) -> DataFrame:
    """What is in an artifact whose build was broken off and taken up again: every row once, as a result or a failure."""
    root, e = shared.shared_path(spark, "build"), views.read(spark, d, "events").select("event_id", "props").withColumn("props", F.expr(_BROKEN))
    for waves in (1, None):
        builds.build(e, "event_id", _parsed, "k long", root, size=_SHARD, wave=_WAVE, most_waves=waves)
    done, failed = builds.load(e, root, "event_id", "k long")
    nothing = lambda kind: F.lit(None).cast(kind)
    return done.withColumn("error", nothing("string")).unionByName(failed.select("event_id", nothing("long").alias("k"), F.split("error", ":")[0].alias("error")))


# ---- enrichment: captions, OCR with regions, context


def _caption(rows: list[dict]) -> list[dict]:
    """A stand-in for a captioner: what a page has; some pages it can't read."""
    if any(r["page_id"] % 17 == 0 for r in rows):
        raise OSError("cannot read the picture")
    return [{"text": f"{len(re.findall(r'[^ ]+', r['html']))} words, {len(re.findall('<a ', r['html']))} links"} for r in rows]


def _ocr(rows: list[dict]) -> list[dict]:
    """A stand-in for OCR: the texts between tags as regions, from the top; it gives up on pages of some lengths."""
    if any(len(r["html"]) % 19 == 0 for r in rows):
        raise RuntimeError("no text engine")
    found = [[x for x in re.findall(r">([^<]+)<", r["html"]) if x.strip(" \n\t\r")] for r in rows]
    return [{"regions": [{"text": t, "confidence": len(t) % 100 / 100} for t in texts]} for texts in found]


_STORE = "store-1"


def enriched(spark: SparkSession, d: str, root: str) -> dict[str, str]:
    """Builds captions, OCR and context of all pages below ``root`` and gives the path of each: every page has a row of each
    kind, a failed one where its model failed; OCR's child rows and its parent rows come from one pass."""
    pages = views.read(spark, d, "pages").select("page_id", "html")
    frame = [F.col("page_id").alias("frame_id"), F.concat(F.lit("v"), F.expr("page_id div 100")).alias("video_id"), F.expr("page_id % 100").alias("frame_idx"), F.expr("page_id % 100 * 1000").alias("timestamp_ms"), F.lit(_STORE).alias("frame_store_id")]
    state = [F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error", F.lit("v1").alias("artifact_version")]
    paths = {k: f"{root}/{k}" for k in ("caption", "ocr", "context")}

    def made(port: builds.Port, result: str, name: str) -> DataFrame:
        builds.build(pages, "page_id", port, result, f"{root}/build-{name}", size=500, batch=32)
        done, failed = builds.load(pages, f"{root}/build-{name}", "page_id", result)
        return done.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)

    captions = made(_caption, "text string", "caption").select(*frame, F.col("text").alias("caption_text"), *state)
    typed.write(captions, "caption", paths["caption"])

    read = made(_ocr, "regions array<struct<text: string, confidence: double>>", "ocr")
    quality = F.aggregate("regions", F.lit(0.0), lambda s, r: s + r["confidence"]) / F.size("regions")
    quality = F.when(F.size("regions") > 0, quality)
    parents = read.select(*frame, F.array_join("regions.text", "\n").alias("ocr_text"), quality.alias("quality"), *state)
    each = read.select(F.col("page_id").alias("frame_id"), F.posexplode("regions").alias("region_order", "r"))
    name = F.concat_ws(":", F.col("frame_id").cast("string"), F.col("region_order").cast("string"))
    typed.write(parents, "ocr", paths["ocr"], each.select("frame_id", name.alias("region_id"), "region_order", "r.text", "r.confidence"))

    seen = {k: typed.usable(typed.read(spark, k, paths[k], _STORE, "v1"), k).withColumnRenamed("text", k) for k in ("caption", "ocr")}
    said = pages.withColumnRenamed("page_id", "frame_id").join(seen["caption"], "frame_id", "left").join(seen["ocr"], "frame_id", "left").withColumnRenamed("frame_id", "page_id")
    context = F.nullif(F.concat_ws("\n", "caption", "ocr"), F.lit(""))
    versions = [F.lit(v).alias(c) for c, v in (("context_version", "c1"), ("caption_version", "v1"), ("ocr_version", "v1"), ("object_version", "none"))]
    typed.write(said.select(*frame, context.alias("context_text"), *versions), "context", paths["context"])
    return paths


ENRICHED = r"""WITH p AS (SELECT page_id AS frame_id, html, CASE WHEN page_id % 17 <> 0 THEN len(regexp_extract_all(html, '[^ ]+')) || ' words, ' || len(regexp_extract_all(html, '<a ')) || ' links' END AS caption,
    CASE WHEN length(html) % 19 <> 0 THEN list_filter(regexp_extract_all(html, '>([^<]+)<', 1), lambda x: regexp_matches(x, '[^ \n\t\r]')) END AS regions FROM pages),
  o AS (SELECT *, array_to_string(regions, chr(10)) AS ocr FROM p)"""


@query(ENRICHED + """ SELECT 'caption' AS kind, count(*) AS rows, count(caption) AS completed, count(caption) AS usable, 0::BIGINT AS children, sum(('0x' || md5(frame_id || coalesce(caption, '-'))[1:8])::BIGINT)::BIGINT AS digest FROM o
  UNION ALL SELECT 'ocr', count(*), count(ocr), count(*) FILTER (WHERE trim(ocr) <> ''), coalesce(sum(len(regions)), 0)::BIGINT, sum(('0x' || md5(frame_id || coalesce(ocr, '-'))[1:8])::BIGINT)::BIGINT FROM o
  UNION ALL SELECT 'context', count(*), count(*), count(*) FILTER (WHERE concat_ws(chr(10), caption, nullif(ocr, '')) <> ''), 0, sum(('0x' || md5(frame_id || coalesce(nullif(concat_ws(chr(10), caption, nullif(ocr, '')), ''), '-'))[1:8])::BIGINT)::BIGINT FROM o""")
def enrichment_build(spark: SparkSession, d: str) -> DataFrame:
    """Captions, OCR and context of all pages built, written and read again: how many rows, completed, usable, and a digest of
    their texts (a sum over them)."""
    paths = enriched(spark, d, shared.shared_path(spark, "enriched"))
    pages = views.read(spark, d, "pages").select(F.col("page_id").alias("frame_id"))
    out = None
    for kind, path in paths.items():
        rows = typed.read(spark, kind, path, _STORE)
        typed.covers(rows, pages)
        done = F.sum((F.col("status") == "completed").cast("long")) if "status" in rows.columns else F.count("*")
        each = F.md5(F.concat(F.col("frame_id").cast("string"), F.coalesce(typed.KINDS[kind].text, F.lit("-"))))
        digest = F.sum(F.conv(F.substring(each, 1, 8), 16, 10).cast("long"))
        usable = typed.usable(rows, kind).count()
        children = typed.children(spark, kind, path).count() if typed.KINDS[kind].children else 0
        part = rows.agg(F.count("*").alias("rows"), done.alias("completed"), digest.alias("digest"))
        part = part.select(F.lit(kind).alias("kind"), "rows", "completed", F.lit(usable).cast("long").alias("usable"), F.lit(children).cast("long").alias("children"), "digest")
        out = part if out is None else out.unionByName(part)
    return out


@query(ENRICHED + ", r AS (SELECT frame_id, unnest(regions) AS text, unnest(range(len(regions))) AS i FROM o) SELECT frame_id, frame_id || ':' || i AS region_id, i::INTEGER AS region_order, text, (length(text) % 100) / 100.0::DOUBLE AS confidence FROM r")
def ocr_child_rows(spark: SparkSession, d: str) -> DataFrame:
    """The regions of all pages, which were written with their parents."""
    return typed.children(spark, "ocr", enriched(spark, d, shared.shared_path(spark, "enriched"))["ocr"])


@query(ENRICHED + """, r AS (SELECT frame_id, len(list_filter(regions, lambda x: length(x) % 100 >= 30)) AS good, len(regions) AS n, CASE WHEN len(regions) > 0 THEN list_avg(list_transform(regions, lambda x: (length(x) % 100) / 100.0::DOUBLE)) END AS quality, ocr FROM o)
  SELECT frame_id // 100 AS video, count(*) AS frames, count(ocr) AS completed, round(count(*) FILTER (WHERE ocr <> '') / count(*), 6) AS text_rate, round(count(*) FILTER (WHERE n > 0) / count(*), 6) AS region_rate,
    coalesce(sum(n), 0)::BIGINT AS regions, coalesce(sum(good), 0)::BIGINT AS usable_regions, round(coalesce(avg(CASE WHEN ocr IS NOT NULL THEN coalesce(quality, 0) END), 0), 6) AS mean_quality,
    round(1 - count(ocr) / count(*), 6) AS failure_rate, CASE WHEN count(ocr) < count(*) THEN 'RuntimeError:' || (count(*) - count(ocr)) ELSE '' END AS errors FROM r GROUP BY ALL""")
def ocr_report(spark: SparkSession, d: str) -> DataFrame:
    """How far the OCR of each video's frames has come: rates of text, regions and failures, mean quality, and how often
    which error."""
    path = enriched(spark, d, shared.shared_path(spark, "enriched"))["ocr"]
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    regions = typed.children(spark, "ocr", path).groupBy("frame_id").agg(F.count("*").alias("n"), n(F.col("confidence") >= 0.3).alias("good"))
    rows = typed.read(spark, "ocr", path, _STORE).join(regions, "frame_id", "left").fillna(0, ["n", "good"])
    rows = rows.withColumn("video", F.expr("frame_id div 100"))
    done, rate = F.col("status") == "completed", lambda c: F.round(n(c) / F.count("*"), 6)
    kinds = rows.where(~done).groupBy("video", F.split("error", ":")[0].alias("kind")).agg(F.count("*").alias("k"))
    kinds = kinds.groupBy("video").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "kind", F.col("k").cast("string")))), ",").alias("errors"))
    report = rows.groupBy("video").agg(
        F.count("*").alias("frames"), n(done).alias("completed"), rate(done & (F.col("ocr_text") != "")).alias("text_rate"), rate(F.col("n") > 0).alias("region_rate"),
        F.sum("n").alias("regions"), F.sum("good").alias("usable_regions"), F.round(F.coalesce(F.avg(F.when(done, F.coalesce("quality", F.lit(0.0)))), F.lit(0.0)), 6).alias("mean_quality"),
        rate(~done).alias("failure_rate"),
    )
    return report.join(kinds, "video", "left").fillna("", ["errors"])


def _evidence_kinds(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Five kinds of evidence of the documents, transcripts and detections."""
    frame = lambda i, v: [i.cast("long").alias("frame_id"), v.cast("string").alias("video_id"), i.cast("long").alias("frame_idx"), (i * 1000).cast("long").alias("timestamp_ms"), F.lit(_STORE).alias("frame_store_id")]
    done = lambda c: [F.when(c, "completed").otherwise("failed").alias("status"), F.when(~c, "refused").alias("error"), F.lit("v1").alias("artifact_version")]
    docs, labels, pages = (views.read(spark, d, t) for t in ("documents", "labels", "pages"))
    i = F.col("doc_id")
    own = frame(i, F.col("source"))
    segments = views.segments(spark, d).withColumn("i", F.col("video_id") * 1000 + F.col("segment_index"))
    counts = views.detections(spark, d).groupBy("video_id").agg(F.count("*").alias("n"))
    versions = [F.lit(v).alias(c) for c, v in (("context_version", "c1"), ("caption_version", "v1"), ("ocr_version", "v1"), ("object_version", "v1"))]
    return {
        "caption": docs.join(labels, "doc_id").select(*own, F.col("text").alias("caption_text"), *done(F.col("toxic") == 0)),
        "ocr": pages.select(*frame(F.col("page_id"), F.lit("pages")), F.col("url").alias("ocr_text"), (F.col("page_id") % 10 / 10).alias("quality"), *done(F.col("page_id") % 5 != 0)),
        "object": counts.select(*frame(F.col("video_id"), F.lit("events")), F.to_json(F.create_map(F.lit("event"), "n")).alias("counts_json"), F.concat(F.lit("event x"), "n").alias("summary"), *done(F.lit(True))),
        "context": docs.select(*own, F.concat_ws(" ", "lang", "source").alias("context_text"), *versions),
        "asr": segments.select(*frame(F.col("i"), F.col("video_id")), F.col("text").alias("transcript_text"), "start_ms", "end_ms", *done(F.col("status") == "completed")),
    }


@query(with_views("segments", """ SELECT 'caption' AS kind, count(*) AS rows, count(*) FILTER (WHERE toxic = 0 AND trim(text) <> '') AS usable, 'store-1' AS lineage, 'v1' AS version FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'ocr', count(*), count(*) FILTER (WHERE page_id % 5 <> 0 AND trim(url) <> ''), 'store-1', 'v1' FROM pages UNION ALL SELECT 'object', count(DISTINCT user_id), count(DISTINCT user_id), 'store-1', 'v1' FROM events
  UNION ALL SELECT 'context', count(*), count(*), 'store-1', 'c1' FROM documents UNION ALL SELECT 'asr', count(*), count(*) FILTER (WHERE status = 'completed' AND trim(text) <> ''), 'store-1', 'v1' FROM segments"""))
def uniform_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Five kinds of evidence written under their schemas, read against their manifests, and what they say of themselves."""
    root, out = shared.shared_path(spark, "typed"), None
    for kind, rows in _evidence_kinds(spark, d).items():
        path = f"{root}/{kind}"
        told = typed.write(rows, kind, path, rows.select("frame_id").limit(0).selectExpr("frame_id", "cast(null as string) region_id", "cast(null as int) region_order", "cast(null as string) text", "cast(null as double) confidence") if typed.KINDS[kind].children else None)
        got = typed.read(spark, kind, path, _STORE)
        usable = typed.usable(got, kind).agg(F.count("*").alias("usable"))
        version = told[typed.KINDS[kind].versions[0]]
        part = usable.select(F.lit(kind).alias("kind"), F.lit(told["rows"]).cast("long").alias("rows"), "usable", F.lit(told["frame_store_id"]).alias("lineage"), F.lit(version).alias("version"))
        out = part if out is None else out.unionByName(part)
    return out
