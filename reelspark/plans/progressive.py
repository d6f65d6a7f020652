"""Queries of progressive search, streams, bundles and ports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..operators import fusion, ports, progressive, vector
from ..sources import bundles, shared, views
from ..sources.views import with_views
from ..streaming import events, sessions
from . import scalars
from .registry import query
from .relational import hits

_HITS = "frames queries hits"

#: Small enough that on the test tables videos are missed, made up for, and dropped.
BUDGET = progressive.Budget(everywhere=20, within=12, kept=3, backfill_videos=3, backfill_hints=2, pool=6, least=0.05)
STEPS = 4


def _hints_of_four(spark: SparkSession, d: str) -> DataFrame:
    """The queries as sessions of four hints."""
    return views.queries(spark, d).withColumns({"task": F.expr("query_id div 80"), "event": F.expr("cast(query_id div 20 % 4 as int)")})


def _acquired_sql(b: progressive.Budget = BUDGET, steps: int = STEPS) -> str:
    """The state after each step as expressions: ev{k} (evaluated pairs), fo{k} (found frames), po{k} (the pool), lo{k} (its log)."""
    top = lambda by, order, n: f"QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {order}) <= {n}"
    best = f"task, event, video_id, frame_id, timestamp_ms, max(score) AS score"  # noqa: F541
    kept = top("task, event, video_id", "score DESC, timestamp_ms, frame_id", b.kept)
    out = [
        "hints AS (SELECT query_id, query, query_id // 80 AS task, (query_id // 20 % 4)::INTEGER AS event FROM queries)",
        f"""scored AS (SELECT * FROM (SELECT q.task, q.event, f.frame_id, f.video_id, f.timestamp_ms, round(list_inner_product(q.query::DOUBLE[], f.embedding::DOUBLE[]), 6) AS score
  FROM hints q, frames f) WHERE score >= {b.least})""",
        "po_ AS (SELECT 0::BIGINT AS task, 0::BIGINT AS video_id, 0 AS place WHERE false), ev_ AS (SELECT 0::BIGINT AS task, 0 AS event, 0::BIGINT AS video_id WHERE false)",
        "fo_ AS (SELECT * FROM scored WHERE false)",
    ]
    for k in range(steps):
        p = str(k - 1) if k else "_"
        out.append(f"""ac{k} AS (SELECT DISTINCT task FROM hints WHERE event = {k}), be{k} AS (SELECT * FROM po{p} SEMI JOIN ac{k} USING (task)),
gl{k} AS (SELECT *, 0 AS branch, row_number() OVER (PARTITION BY task ORDER BY score DESC, frame_id) AS rank FROM scored WHERE event = {k} QUALIFY rank <= {b.everywhere}),
ne{k} AS (SELECT *, 1 AS branch, row_number() OVER (PARTITION BY task ORDER BY score DESC, frame_id) AS rank FROM scored SEMI JOIN be{k} USING (task, video_id) WHERE event = {k} QUALIFY rank <= {b.within}),
ro{k} AS (SELECT * FROM gl{k} UNION ALL SELECT * FROM ne{k}),
fi{k} AS (SELECT task, video_id, min((branch, rank)) AS first FROM ro{k} GROUP BY ALL),
fr{k} AS (SELECT * FROM (SELECT {best} FROM ro{k} GROUP BY ALL) {kept}),
se{k} AS (SELECT * FROM ev{p} UNION SELECT task, {k}, video_id FROM fi{k}),
un{k} AS (SELECT v.task, h.event, v.video_id FROM (SELECT task, video_id FROM be{k} UNION SELECT task, video_id FROM fi{k}) v JOIN hints h ON h.task = v.task AND h.event <= {k} ANTI JOIN se{k} s ON s.task = v.task AND s.event = h.event AND s.video_id = v.video_id),
ta{k} AS (SELECT * FROM (SELECT task, video_id, 0 AS kind, first[1] AS a, first[2] AS b FROM fi{k} ANTI JOIN be{k} USING (task, video_id)
  UNION ALL SELECT task, video_id, 1, 0, place FROM be{k} SEMI JOIN un{k} USING (task, video_id)) {top("task", "kind, a, b, video_id", b.backfill_videos)}),
mi{k} AS (SELECT task, event, video_id FROM un{k} SEMI JOIN ta{k} USING (task, video_id) {top("task, video_id", "event", b.backfill_hints)}),
ma{k} AS (SELECT * FROM (SELECT {best} FROM scored SEMI JOIN mi{k} USING (task, event, video_id) GROUP BY ALL) {kept}),
al{k} AS (SELECT * FROM se{k} UNION ALL SELECT * FROM mi{k}),
fa{k} AS (SELECT task, event, video_id, frame_id, timestamp_ms, score FROM fr{k} UNION ALL SELECT task, event, video_id, frame_id, timestamp_ms, score FROM ma{k} UNION ALL SELECT task, event, video_id, frame_id, timestamp_ms, score FROM fo{p}),
bv{k} AS (SELECT task, event, video_id, max(score) AS best FROM fa{k} SEMI JOIN ac{k} USING (task) GROUP BY ALL),
bo{k} AS (SELECT task, event, least(0, min(best)) AS low, max(best) AS high FROM bv{k} GROUP BY ALL),
sm{k} AS (SELECT task, video_id, round(avg(CASE WHEN high <= low THEN 1.0::DOUBLE ELSE least(1, greatest(0, (best - low) / (high - low))) END), 9) AS semantic, count(*) AS matched FROM bv{k} JOIN bo{k} USING (task, event) GROUP BY ALL),
sc{k} AS (SELECT task, video_id, round({b.weights[0]}::DOUBLE * coalesce(semantic, 0) + {b.weights[1]}::DOUBLE * coalesce(matched, 0) / {k + 1} + {b.weights[2]}::DOUBLE * evaluated / {k + 1}, 12) AS score
  FROM (SELECT task, video_id, count(DISTINCT event) AS evaluated FROM al{k} SEMI JOIN ac{k} USING (task) GROUP BY ALL) LEFT JOIN sm{k} USING (task, video_id)),
po{k} AS (SELECT task, video_id, row_number() OVER (PARTITION BY task ORDER BY score DESC, video_id) AS place FROM sc{k} QUALIFY place <= {b.pool} UNION ALL SELECT task, video_id, place FROM po{p} ANTI JOIN ac{k} USING (task)),
ev{k} AS (SELECT * FROM al{k} SEMI JOIN po{k} USING (task, video_id)), fo{k} AS (SELECT * FROM fa{k} SEMI JOIN po{k} USING (task, video_id)),
lo{k} AS (SELECT task, {k} AS step, count(*) AS searched, (SELECT count(*) FROM ta{k} t WHERE t.task = f.task AND kind = 0) AS rescued, (SELECT count(*) FROM ta{k} t WHERE t.task = f.task) AS targets,
  (SELECT count(*) FROM mi{k} m WHERE m.task = f.task) AS made_up FROM fi{k} f GROUP BY task)""")
    return ", " + ",\n".join(out)


ACQUIRED = with_views("frames queries", _acquired_sql())
_LAST = STEPS - 1


@query(ACQUIRED + f" SELECT task, event, video_id, frame_id, score FROM fo{_LAST}")
def acquire_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Four hints one after the other: each everywhere and within the videos that stay, what is missing made up for, within
    limits; the frames that are kept of each hint and video after the last."""
    return progressive.acquire(_hints_of_four(spark, d), views.frames(spark, d), BUDGET).found.select("task", "event", "video_id", "frame_id", "score")


@query(ACQUIRED + " " + " UNION ALL ".join(f"SELECT * FROM lo{k}" for k in range(STEPS)))
def acquire_log(spark: SparkSession, d: str) -> DataFrame:
    """What each step of each session has searched, rescued and made up for."""
    return progressive.acquire(_hints_of_four(spark, d), views.frames(spark, d), BUDGET).log


@query(ACQUIRED + f""" SELECT p.task, h.event, p.video_id, CASE WHEN e.task IS NULL THEN 'UNKNOWN' WHEN f.n IS NULL THEN 'NO_MATCH' ELSE 'MATCH' END AS state, coalesce(f.n, 0) AS frames
  FROM po{_LAST} p JOIN hints h USING (task) LEFT JOIN ev{_LAST} e ON e.task = p.task AND e.event = h.event AND e.video_id = p.video_id
  LEFT JOIN (SELECT task, event, video_id, count(*) AS n FROM fo{_LAST} GROUP BY ALL) f ON f.task = p.task AND f.event = h.event AND f.video_id = p.video_id""")
def acquire_states(spark: SparkSession, d: str) -> DataFrame:
    """Each hint in each video that stays: matched, searched for without a match, or unknown."""
    hints = _hints_of_four(spark, d)
    return progressive.states(progressive.acquire(hints, views.frames(spark, d), BUDGET), hints)


@query(with_views("frames queries tasks hits", """, h AS (SELECT hits.*, task FROM hits JOIN tasks USING (query_id)), v AS (SELECT DISTINCT task, video_id FROM h),
  e AS (SELECT query_id, video_id, count(*) FILTER (WHERE rank <= 15) AS n FROM h GROUP BY ALL)
  SELECT t.query_id, v.video_id, CASE WHEN e.n IS NULL THEN 'UNKNOWN' WHEN e.n = 0 THEN 'NO_MATCH' ELSE 'MATCH' END AS state, coalesce(e.n, 0) AS frames
  FROM tasks t JOIN v USING (task) LEFT JOIN e ON e.query_id = t.query_id AND e.video_id = v.video_id"""))
def evaluation_state(spark: SparkSession, d: str) -> DataFrame:
    """Each unit of a task and each video that any of its units has found: matched, evaluated without a match, or never
    evaluated."""
    tasks = views.tasks(spark, d).select("query_id", "task")
    h = shared.written(hits(spark, d).select("query_id", "video_id", "rank").join(tasks, "query_id"), "evaluated")
    seen = h.groupBy("query_id", "video_id").agg(F.sum((F.col("rank") <= 15).cast("long")).alias("n"))
    j = tasks.join(h.select("task", "video_id").distinct(), "task").join(seen, ["query_id", "video_id"], "left")
    state = F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("n") == 0, "NO_MATCH").otherwise("MATCH")
    return j.select("query_id", "video_id", state.alias("state"), F.coalesce("n", F.lit(0)).alias("frames"))


def _hints(spark: SparkSession, d: str) -> DataFrame:
    """Growing hints: a conversation's turns so far; every fifth starts over.  Eight stores hear them, a turn in 400 seconds;
    every eleventh session changes its context on the way."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = views.read(spark, d, "conversations")
    hint = F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(F.array_join(F.collect_list("text").over(w), " "))
    seen = F.when(F.col("turn") % 6 == 3, F.col("turn") % 4).cast("int")  # of some hints the version their sender has seen
    at = F.col("turn").cast("long") * 400_000 + F.col("conv_id") * 1000
    context = F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") > 3), "vqa").otherwise("kis")
    return c.select(
        (F.col("conv_id") % 8).alias("store"), F.col("conv_id").alias("session"), at.alias("at"), F.col("turn").cast("long").alias("seq"),
        hint.alias("hint"), seen.alias("base"), context.alias("context"),
    )


@query()
def session_replay(spark: SparkSession, d: str) -> DataFrame:
    return sessions.replay(_hints(spark, d), most=64)


@query()
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same hints as a stream with keyed state."""
    path = shared.shared_path(spark, "hints")
    _hints(spark, d).write.parquet(path)
    return events.drained(sessions.stream(events.source(spark, path, sessions.HINTS), most=64), "session-stream", "append")


@query()
def progressive_search(spark: SparkSession, d: str) -> DataFrame:
    """Sessions step by step over their hints: each new unit with the relation it states, the evidence acquired for it and made
    up for among transcript segments, and after the last the three best scenes by evidence, coverage, compactness and the
    relations that were stated."""
    # every session has a store of its own, and lives on
    heard = _hints(spark, d).drop("store", "at", "context")
    steps = sessions.replay(heard).where("decision in ('FIRST', 'APPEND')").where("unit <> ''")
    steps = shared.written(steps.select("session", "version", "unit"), "steps")
    relation = text.temporal_relation(F.col("unit"), F.col("version") > 1)
    counted = steps.withColumn("units", F.count("*").over(W.partitionBy("session"))).withColumn("relation", relation)
    coded = ports.encode(counted, "unit", ports.hashing_encoder())
    units = coded.select(
        (F.col("session") * 1000 + F.col("version")).alias("query_id"), F.col("session").alias("task"), (F.col("version") - 1).alias("event"),
        "units", "relation", F.col("embedding").alias("query"),
    )
    units = shared.written(units, "units")
    segments = views.segments(spark, d).where("status = 'completed'")
    index = ports.encode(segments, "text", ports.hashing_encoder()).where("embedding is not null").select(
        (F.col("video_id") * 1000 + F.col("segment_index")).alias("frame_id"), "video_id", F.col("start_ms").alias("timestamp_ms"), "embedding"
    )
    index = shared.written(index, "index")
    state = progressive.acquire(units, index, progressive.Budget(least=0.02))
    at_end = F.col("relation") == "AT_END"
    subject, object_ = F.when(at_end, F.col("event")).otherwise(F.col("event") - 1), F.when(~at_end, F.col("event"))
    said = units.where("relation is not null").select("task", "relation", subject.alias("subject"), object_.alias("object"))
    best = progressive.aligned(state, said, units.groupBy("task").agg(F.count("*").alias("units")), per_video=3, most=3)
    held = [F.round(c, 6).alias(c) for c in ("coverage", "evaluation", "related", "score")]
    return best.select(F.col("task").alias("session"), F.col("place").cast("int").alias("place"), "video_id", "start_ms", "end_ms", *held)


#: Three calls a question; a window costs one, and one more if it is asked again, so what comes before decides whether it is
#: asked at all.
_ASKED = """WITH q AS (SELECT conv_id, text AS asked FROM conversations WHERE turn = 0), k AS (SELECT conv_id, {kind} AS kind FROM q),
  w AS (SELECT conv_id, turn, length(text) AS n, split_part(text, ' ', 1) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn)::INTEGER AS place FROM conversations WHERE turn > 0),
  a AS (SELECT *, n % 11 = 0 AS broken, n % 11 <> 0 AND n % 5 <> 0 AS good, (n % 10) / 10.0::DOUBLE AS c1, (n % 7) / 7.0::DOUBLE AS c2, n % 9 = 0 AS broken2 FROM w JOIN k USING (conv_id) WHERE place <= 3),
  b AS (SELECT *, kind = 'TEMPORAL' AND n % 13 <> 0 AND (NOT good OR c1 < 0.4) AS again FROM a),
  c AS (SELECT *, coalesce(sum(1 + again::INT) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
  SELECT conv_id, place, kind, (before + 1)::INTEGER AS call, false AS retried, CASE WHEN good THEN said END AS answer, CASE WHEN good THEN turn::BIGINT END AS frame_id, CASE WHEN good THEN round(c1, 6) END AS confidence,
    CASE WHEN broken THEN 'ValueError: too long' WHEN NOT good THEN 'frame_not_shown' ELSE '' END AS warnings FROM c WHERE before < 3
  UNION ALL SELECT conv_id, place, kind, (before + 2)::INTEGER, true, CASE WHEN NOT broken2 THEN said END, CASE WHEN NOT broken2 THEN turn::BIGINT + 1 END, CASE WHEN NOT broken2 THEN round(c2, 6) END,
    'temporal_neighbor_fallback' || CASE WHEN broken2 THEN ',ValueError: too long' ELSE '' END FROM c WHERE again AND before < 2"""


def _middle(texts: list[str], kinds: list[str], frames: list[list[int]]) -> tuple[list[str], list[int], list[float]]:
    """A stand-in for a model: names the last frame, or for some texts one that it was not shown, and fails for some."""
    wide = [len(f) > 1 for f in frames]
    if any(len(t) % (9 if w else 11) == 0 for t, w in zip(texts, wide)):
        raise ValueError("too long")
    at = [f[-1] if w or len(t) % 5 else -1 for t, f, w in zip(texts, frames, wide)]
    return [t.split(" ")[0] for t in texts], at, [len(t) % 7 / 7 if w else len(t) % 10 / 10 for t, w in zip(texts, wide)]


@query(_ASKED.replace("{kind}", scalars.kind_sql("asked")))
def answer_questions(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's first turn as a question, its longest other turns as windows to answer from, in three calls."""
    c = views.read(spark, d, "conversations")
    asked = c.where("turn = 0").select(F.col("conv_id").alias("question"), text.question_kind(F.col("text")).alias("kind"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), "turn"))
    turn = F.col("turn").cast("long")
    wide = F.when(F.col("n") % 13 != 0, F.array(turn, turn + 1))
    w = c.where("turn > 0").withColumn("n", F.length("text")).withColumn("place", place)
    w = w.select(F.col("conv_id").alias("question"), "place", "text", F.array(turn).alias("frames"), wide.alias("wide")).join(asked, "question")
    got = ports.answer(w, _middle, most=3)
    return got.select(
        F.col("question").alias("conv_id"), "place", "kind", "call", "retried", "answer", "frame_id", F.round("confidence", 6).alias("confidence"),
        F.array_join("warnings", ",").alias("warnings"),
    )


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = events.source(spark, f"{d}/[e]vents.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    return events.drained(events.tumbling(e), "tumbling")


@query("""SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return events.session_windows(views.read(spark, d, "events")).select("user_id", "n", "total")


@query(with_views("frames segments evidence", """ SELECT 'frames' AS name, count(*) AS rows, 64 AS dimension FROM frames UNION ALL SELECT 'segments', count(*), 0 FROM segments UNION ALL SELECT 'captions', count(*), 0 FROM captions
  UNION ALL SELECT 'ocr', count(*), 0 FROM ocr UNION ALL SELECT 'objects', count(*), 0 FROM objects"""))
def bundle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Five tables published under a version, the manifest last, then a second version of fewer; rolled back, and the first
    loaded by the pointer, its schemas, rows, digests and dimensions verified."""
    root = shared.shared_path(spark, "bundle")
    _, captions, ocr, objects = views.evidence(spark, d)
    tables = {"frames": views.frames(spark, d), "segments": views.segments(spark, d), "captions": captions, "ocr": ocr, "objects": objects}
    bundles.publish(tables, root, "v1", {"dimension": 64})
    bundles.publish({"ocr": ocr}, root, "v2")
    bundles.rollback(spark, root, "v1")
    out = None
    for name, df in bundles.load(spark, root).items():
        size = F.max(F.size("embedding")) if "embedding" in df.columns else F.lit(0)
        part = df.agg(F.count("*").alias("rows"), size.alias("dimension")).select(F.lit(name).alias("name"), "rows", "dimension")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT source, lang, sha256(source || '|' || lang || '|v2') AS identity, count(*) AS rows, sha256(source || '|' || lang || '|v2') = sha256(source || '|' || lang || CASE WHEN source < 'src2' THEN '|v1' ELSE '|v2' END) AS complete, source >= 'src2' AND lang = 'en' AS usable FROM documents GROUP BY ALL")
def stage_identity(spark: SparkSession, d: str) -> DataFrame:
    """A stage is complete where its recorded identity (inputs and configuration) is what it would be now, and usable for
    English where its record has the version and the language, whatever else it has."""
    ident = lambda v: F.sha2(F.concat_ws("|", "source", "lang", v), 256)
    told = ident(F.when(F.col("source") < "src2", "v1").otherwise("v2"))
    g = views.read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("rows"))
    version = F.when(F.col("source") < "src2", "v1").otherwise("v2")
    record = F.to_json(F.struct("source", F.struct(F.struct("lang", "rows").alias("input"), version.alias("version")).alias("config")))
    usable = text.json_has(record, {"config": {"input": {"lang": "en"}, "version": "v2"}})
    complete = (ident(F.lit("v2")) == told).alias("complete")
    return g.select("source", "lang", ident(F.lit("v2")).alias("identity"), "rows", complete, usable.alias("usable"))


@query()
def text_index_build(spark: SparkSession, d: str) -> DataFrame:
    """Segments encoded (each distinct text once), checked, and published as a vector bundle; its validation."""
    s = views.segments(spark, d).where("status = 'completed'").select("segment_id", "video_id", "text")
    coded = ports.encode(s, "text", ports.hashing_encoder()).drop("text").where("embedding is not null")
    root = shared.shared_path(spark, "text-index")
    bundles.publish({"vectors": coded}, root, "v1")
    got = bundles.load(spark, root)["vectors"]
    return got.groupBy("video_id").agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dimension"), F.round(F.max(F.abs(vector.norm("embedding") - 1)), 4).alias("off_unit"))


@query(with_views(_HITS, " SELECT query_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 15 THEN frame_id % 17 END DESC NULLS LAST, rank)::INTEGER AS place FROM hits"))
def rerank_port(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).select("query_id", "frame_id", "rank")
    return ports.rerank(h, lambda b: (b["frame_id"] % 17).to_numpy(np.float64), 15).select("query_id", "frame_id", "place")
