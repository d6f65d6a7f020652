"""Queries of scalar functions and of smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numeric, text
from ..operators import evidence, joins, traces, vector
from ..sources import views
from ..sources.views import with_views
from .registry import query
from .relational import hits

_HITS = "frames queries hits"
_C = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _collapse(x: str) -> str:
    return _C.format(x)


def _fold(x: str) -> str:
    """SQL that composes and folds case."""
    return f"replace(lower(nfc_normalize({x})), 'ß', 'ss')"


@query(f"SELECT conv_id, turn, {_collapse('nfc_normalize(text)')} AS clean, coalesce(lower(nullif(role, 'user')), 'und') AS language FROM conversations")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    c = views.read(spark, d, "conversations")
    return c.select("conv_id", "turn", text.nfc_collapse(F.col("text")).alias("clean"), F.coalesce(F.lower(F.nullif("role", F.lit("user"))), F.lit("und")).alias("language"))


_SNAP = "trim(regexp_replace(regexp_replace(" + _collapse("nfc_normalize({0})") + ", '\\s+([,.;:!?])', '\\1', 'g'), '([,.;:!?])([^\\s,.;:!?])', '\\1 \\2', 'g'))"


@query(f"SELECT item_id, {_SNAP.format('text')} AS clean, {_fold("regexp_replace(" + _SNAP.format('text') + ", '[\\p{P}\\p{Z}\\s]', '', 'g')")} AS key FROM benchmark")
def snapshot_keys(spark: SparkSession, d: str) -> DataFrame:
    clean = text.snapshot(F.col("text"))
    return views.read(spark, d, "benchmark").select("item_id", clean.alias("clean"), text.semantic_key(clean).alias("key"))


@query("""WITH s AS (SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn) || CASE WHEN turn = 3 THEN '.' ELSE '' END AS hint FROM conversations),
  n AS (SELECT conv_id, turn, """ + _SNAP.format("hint") + """ AS b, lag(""" + _SNAP.format("hint") + """) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM s),
  k AS (SELECT *, """ + _fold("regexp_replace(a, '[\\p{P}\\p{Z}\\s]', '', 'g')") + " = " + _fold("regexp_replace(b, '[\\p{P}\\p{Z}\\s]', '', 'g')") + """ AS same FROM n)
  SELECT conv_id, turn, CASE WHEN a IS NULL THEN 'FIRST' WHEN same THEN 'NO_CHANGE' WHEN starts_with(b, a) THEN 'APPEND' ELSE 'REPLACEMENT' END AS kind,
  CASE WHEN a IS NULL THEN b WHEN NOT same AND starts_with(b, a) THEN trim(substring(b, length(a) + 1)) END AS delta FROM k""")
def snapshot_delta(spark: SparkSession, d: str) -> DataFrame:
    """Growing hints of a session: what each snapshot adds to the one before."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = views.read(spark, d, "conversations")
    hint = F.concat(F.array_join(F.collect_list("text").over(w), " "), F.when(F.col("turn") == 3, ".").otherwise(""))
    c = c.withColumn("hint", hint).withColumn("before", F.lag("hint").over(w))
    kind, delta = text.snapshot_change(F.col("before"), F.col("hint"))
    return c.select("conv_id", "turn", kind.alias("kind"), delta.alias("delta"))


@query(with_views("evidence", f""" , j AS (SELECT b.frame_id, c.caption_text, o.ocr_text, x.object_summary FROM base b LEFT JOIN captions c USING (frame_id) LEFT JOIN ocr o USING (frame_id) LEFT JOIN objects x USING (frame_id))
  SELECT frame_id, nullif(concat_ws(chr(10) || chr(10), CASE WHEN length({_collapse('caption_text')}) > 0 THEN '[CAPTION]' || chr(10) || array_to_string(string_split({_collapse('caption_text')}, ' ')[1:80], ' ') END,
  CASE WHEN length({_collapse('ocr_text')}) > 0 THEN '[VISIBLE_TEXT]' || chr(10) || array_to_string(string_split({_collapse('ocr_text')}, ' ')[1:80], ' ') END,
  CASE WHEN length({_collapse('object_summary')}) > 0 THEN '[OBJECTS]' || chr(10) || array_to_string(string_split({_collapse('object_summary')}, ' ')[1:2], ' ') END), '') AS context FROM j"""))
def context_text(spark: SparkSession, d: str) -> DataFrame:
    base, captions, ocr, objects = views.evidence(spark, d)
    j = base.join(captions, "frame_id", "left").join(ocr, "frame_id", "left").join(objects, "frame_id", "left")
    parts = [("CAPTION", F.col("caption_text"), 80), ("VISIBLE_TEXT", F.col("ocr_text"), 80), ("OBJECTS", F.col("object_summary"), 2)]
    return j.select("frame_id", text.sections(parts).alias("context"))


def _says(x: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


_FOLDED = _collapse(_fold("text"))


@query(f"""SELECT conv_id, turn, CASE WHEN {_says("t", text.AT_END)} THEN 'AT_END' WHEN before IS NULL THEN NULL WHEN {_says("t", text.OVERLAP)} THEN 'OVERLAP'
  WHEN {_says("t", text.BEFORE)} THEN 'BEFORE' END AS relation
  FROM (SELECT conv_id, turn, {_FOLDED} AS t, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)""")
def temporal_phrases(spark: SparkSession, d: str) -> DataFrame:
    previous = F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")).isNotNull()
    rows = views.read(spark, d, "conversations").withColumn("previous", previous)
    return rows.select("conv_id", "turn", text.temporal_relation(F.col("text"), F.col("previous")).alias("relation"))


def kind_sql(x: str) -> str:
    """The kind of the question that a column holds, as SQL."""
    return _kind(_collapse(_fold(x)))


def _kind(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {_says(x, terms)} THEN '{kind}'" for kind, terms in text.QUESTIONS.items()) + " ELSE 'GENERAL' END"


_WORDS = "(^|[^\\p{L}\\p{N}_])(" + "|".join(text.VIETNAMESE) + ")($|[^\\p{L}\\p{N}_])"


@query(f"""SELECT doc_id, {_kind("t")} AS kind, CASE WHEN regexp_matches(t, '[{text.LETTERS}]|{_WORDS}') THEN 'vi' ELSE 'en' END AS language,
  CASE {_kind("t")} WHEN 'TEXT' THEN 'OCR,VISUAL' WHEN 'SPEECH' THEN 'ASR,VISUAL' ELSE 'VISUAL' END AS modalities FROM (SELECT doc_id, {_FOLDED} AS t FROM documents)""")
def question_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Each text as a question: its kind, the language to answer in, the evidence to look at."""
    q = F.col("text")
    rows = views.read(spark, d, "documents").select("doc_id", text.question_kind(q).alias("kind"), text.question_language(q).alias("language"))
    return rows.withColumn("modalities", text.evidence_of(F.col("kind")))


_PLAIN = _collapse(f"regexp_replace({_fold('text')}, '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g')")
_DIGITS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.COUNTS.items()) + "}"


@query(f"""WITH t AS (SELECT conv_id, turn, {_PLAIN} AS plain, {_FOLDED} AS t FROM conversations),
  q AS (SELECT *, {_kind("lag(t) OVER w")} AS kind FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, kind, CASE WHEN kind = 'COUNT' THEN coalesce({_DIGITS}[plain], plain) ELSE plain END AS answer FROM q""")
def answer_keys(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as the answer to the turn before it."""
    asked = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = views.read(spark, d, "conversations").withColumn("asked", asked)
    rows = rows.select("conv_id", "turn", "text", text.question_kind(F.col("asked")).alias("kind"))
    return rows.select("conv_id", "turn", "kind", text.answer_key(F.col("text"), F.col("kind")).alias("answer"))


_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1))"


@query(f"""SELECT doc_id, item_id, len({_TOK.format('b.text')}) AS n, round(CASE WHEN len({_TOK.format('b.text')}) > 0 THEN len(list_intersect({_TOK.format('b.text')}, {_TOK.format('d.text')})) / len({_TOK.format('b.text')})::DOUBLE ELSE 0 END, 6) AS overlap
  FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id""")
def lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the benchmark item of its number, going round."""
    b = views.read(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    docs = views.read(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % max(1, b.count())).alias("item_id"))
    j = docs.join(b, "item_id")
    return j.select("doc_id", "item_id", F.size(text.tokens(F.col("q"))).cast("long").alias("n"), F.round(text.token_overlap(F.col("q"), F.col("text")), 6).alias("overlap"))


_FOLDERS = ", ".join(f"'{x}'" for x in text.FOLDERS)


@query(f"""WITH p AS (SELECT page_id, url, html, list_filter(string_split(url, '/'), lambda x: x <> '' AND x NOT IN ({_FOLDERS})) AS parts FROM pages)
  SELECT page_id, CASE WHEN len(parts) >= 3 THEN parts[1] || '.' || parts[2] || '.' || regexp_replace(parts[3], '^(.+)\\.[^.]+$', '\\1') ELSE url END AS video_id,
  left(trim(regexp_replace(regexp_replace(html, '(?i)(token|key|secret|password)\\s*[=:]\\s*\\S+', '\\1=***', 'g'), '\\s+', ' ', 'g')), 60) AS message,
  nullif(rtrim(left(trim(regexp_replace(html, '\\s+', ' ', 'g')), 100)), '') AS answer FROM p""")
def path_ids(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "pages").select(
        "page_id", text.video_id(F.col("url")).alias("video_id"), text.bounded_error(F.col("html"), 60).alias("message"), text.short_answer(F.col("html")).alias("answer")
    )


@query("""SELECT event_id, round(greatest(0, least(1, value / 100.0)), 6) AS clamped, round(pow(greatest(value - 50, 0), 1.5), 4) AS power, round(exp(-value / 100.0::DOUBLE), 6) AS penalty,
  round(1.0::DOUBLE / (1 + exp((value - 50) / 20.0::DOUBLE)), 6) AS relevance FROM events""")
def score_functions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return views.read(spark, d, "events").select(
        "event_id", F.round(numeric.clamp(v / 100.0), 6).alias("clamped"), F.round(numeric.clipped_power(v - 50, 1.5), 4).alias("power"),
        F.round(F.exp(-v / 100.0), 6).alias("penalty"), F.round(numeric.relevance((v - 50) / 20.0, F.lit(0.0)), 6).alias("relevance"),
    )


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.0011 AS unit, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    n = vector.norm("embedding")
    return views.read(spark, d, "embeddings").select("vec_id", F.round(n, 5).alias("norm"), (F.abs(n - 1) <= 0.0011).alias("unit"), F.round(vector.normalised("embedding")[0], 6).alias("first"))


@query(with_views("segments turns", """ SELECT s.segment_id, (s.start_ms + s.end_ms) // 2 AS mid, s.start_ms // 15000 AS place, round(max(CASE WHEN least(s.end_ms - s.start_ms, t.end_ms - t.start_ms) > 0 THEN greatest(0, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) / least(s.end_ms - s.start_ms, t.end_ms - t.start_ms)::DOUBLE ELSE 0 END), 6) AS ratio
  FROM segments s JOIN turns t USING (video_id) GROUP BY ALL"""))
def interval_functions(spark: SparkSession, d: str) -> DataFrame:
    """Middles, neighbourhoods and the largest overlap with a turn of the same conversation, of those that overlap at all."""
    s = views.segments(spark, d).select(F.col("segment_id").alias("l_id"), "video_id", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    t = views.turns(spark, d).select("video_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    ratio = numeric.overlap_ratio(*map(F.col, ("l_start", "l_end", "r_start", "r_end")))
    best = joins.overlap_join(s, t, "video_id", 15_000).groupBy("l_id").agg(F.max(ratio).alias("best"))
    ratio = F.round(F.coalesce("best", F.lit(0.0)), 6).alias("ratio")
    return s.join(best, "l_id", "left").select(F.col("l_id").alias("segment_id"), F.expr("(l_start + l_end) div 2").alias("mid"), F.expr("l_start div 15000").alias("place"), ratio)


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 0.6 WHEN 2 THEN 0.9 WHEN 3 THEN 0.5 ELSE greatest(0, least(1, value / 100)) END::DOUBLE AS confidence FROM events")
def confidence_coercion(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 5
    said = F.when(m == 0, " Low").when(m == 1, "medium").when(m == 2, "HIGH").when(m == 3, "unsure").otherwise((F.col("value") / 100).cast("string"))
    return views.read(spark, d, "events").select("event_id", numeric.confidence(said).alias("confidence"))


@query("SELECT event_id, round_even(event_id * 1001.0::DOUBLE * 1000 / 30000, 0)::BIGINT AS ms, round_even(event_id * 40 * (CASE WHEN event_id % 3 = 0 THEN 25.0::DOUBLE ELSE 29.97::DOUBLE END) / 1000.0::DOUBLE, 0)::BIGINT AS frame_idx FROM events")
def time_functions(spark: SparkSession, d: str) -> DataFrame:
    fps = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(29.97)
    e = views.read(spark, d, "events")
    return e.select("event_id", numeric.pts_to_ms(F.col("event_id").cast("double"), 1001, 30000).alias("ms"), numeric.ms_to_frame(F.col("event_id") * 40, fps).alias("frame_idx"))


@query("SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE, 6) AS x, i * 2 AS y FROM (SELECT vec_id, embedding, unnest(generate_series(1, 4)) AS i FROM embeddings)")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    e = views.read(spark, d, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(F.slice("embedding", 1, 4).alias("x"), F.array(*map(F.lit, (2, 4, 6, 8))).alias("y"))).alias("pos", "z"))
    return e.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("z.x").cast("double"), 6).alias("x"), F.col("z.y").cast("long").alias("y"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS key, n + (event_type = 'view')::INT * 100 AS value FROM c UNION ALL SELECT DISTINCT user_id, 'absent', -1 FROM events""")
def map_functions(spark: SparkSession, d: str) -> DataFrame:
    """Counts as a map, merged with defaults where what is there wins, changed by key, and spread again."""
    c = views.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    base = F.create_map(F.lit("absent"), F.lit(-1).cast("long"))
    merged = F.map_zip_with(base, "m", lambda k, a, b: F.coalesce(b, a) + F.when((k == "view") & b.isNotNull(), 100).otherwise(0))
    return m.select("user_id", F.explode(merged).alias("key", "value"))


#: Free text with JSON in it: broken before, nested, with braces in strings, with another object first, or none.
_FREE = """CASE event_id % 5 WHEN 0 THEN 'so {{ not this ' || p || ' but this' WHEN 1 THEN 'it is {{"answer": "a }} b {{", "selected_frame_id": "f' || event_id || '", "confidence": 0.25, "more": ' || p || '}}.'
    WHEN 2 THEN p || ' {{"answer": "later", "selected_frame_id": 7, "answerable": false}}' WHEN 3 THEN '[1, {{"k": {{"j": [' || p || ']}}, "answer": "", "selected_frame_id": 1}}] {{"answer": "x", "selected_frame_id": "y", "confidence": 7}}' ELSE 'nothing {{broken: ' || event_id || '}}' END"""


@query(f"""WITH e AS (SELECT event_id, props::VARCHAR AS p, json_extract(props, '$.k')::BIGINT AS k FROM events), f AS (SELECT event_id, k, {_FREE.replace("{{", "{").replace("}}", "}")} AS said FROM e),
  s AS (SELECT *, unnest(list_filter(range(1, length(said) + 1), lambda i: said[i] = '{{')) AS a FROM f),
  z AS (SELECT *, unnest(list_filter(range(a + 1, length(said) + 1), lambda i: said[i] = '}}')) AS b FROM s),
  o AS (SELECT event_id, a, said[a:b] AS j FROM z WHERE json_valid(said[a:b])),
  g AS (SELECT event_id, a, trim(j->>'answer') AS answer, trim(j->>'selected_frame_id') AS frame, coalesce((j->>'answerable')::BOOLEAN, true) AS answerable, coalesce((j->>'confidence')::DOUBLE, 0.5) AS confidence FROM o),
  h AS (SELECT * FROM g WHERE answer <> '' AND frame <> '' AND confidence BETWEEN 0 AND 1 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY a) = 1)
  SELECT f.event_id, f.k, (SELECT min_by(replace(j, ' ', ''), a) FROM o WHERE o.event_id = f.event_id) AS first_object, answer, frame, answerable, confidence FROM f LEFT JOIN h USING (event_id)""")
def json_functions(spark: SparkSession, d: str) -> DataFrame:
    """A strict field, the first object inside free text, and the first one that is a grounded answer."""
    e = views.read(spark, d, "events").select("event_id", F.col("props").alias("p"))
    free = F.expr(_FREE.replace("{{", "{").replace("}}", "}"))
    e = e.withColumn("said", free).withColumn("g", text.grounded_answer(F.col("said")))
    first = F.regexp_replace(text.first_object(F.col("said")), " ", "")
    return e.select("event_id", F.from_json("p", "k long")["k"].alias("k"), first.alias("first_object"), "g.answer", "g.frame", "g.answerable", "g.confidence")


@query("SELECT doc_id, left(sha1(lang || '/' || source), 12) AS path_id, sha256(source || ':' || doc_id) AS version FROM documents")
def hash_functions(spark: SparkSession, d: str) -> DataFrame:
    p = F.substring(F.sha1(F.concat_ws("/", "lang", "source").cast("binary")), 1, 12)
    return views.read(spark, d, "documents").select("doc_id", p.alias("path_id"), F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 256).alias("version"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN k || '.5' WHEN 2 THEN '"' || k || '"' ELSE k END AS token, value FROM
    (SELECT event_id, value, json_extract_string(props, '$.k') AS k FROM events))
  SELECT event_id, regexp_full_match(token, '-?(0|[1-9][0-9]*)') AS is_integer, value / 100 BETWEEN 0 AND 1 AS is_unit FROM e""")
def strict_numbers(spark: SparkSession, d: str) -> DataFrame:
    """JSON tokens that are integers (not true, 1.5 or "1"), and numbers that are shares."""
    m, k = F.col("event_id") % 5, F.get_json_object("props", "$.k")
    token = F.when(m == 0, "true").when(m == 1, F.concat(k, F.lit(".5"))).when(m == 2, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    share = (F.col("value") / 100).between(0, 1)
    return views.read(spark, d, "events").select("event_id", text.is_integer(token).alias("is_integer"), share.alias("is_unit"))


@query("""SELECT count(*) FILTER (WHERE NOT coalesce(text <> '' AND text = regexp_replace(text, '^\\s+|\\s+$', '', 'g'), false)) AS not_canonical, count(*) FILTER (WHERE n_chars <> length(text)) AS wrong_length,
  count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr', 'es')) AS unknown_lang, count(*) AS rows FROM documents""")
def strict_validation(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return views.read(spark, d, "documents").agg(
        n(~text.is_canonical(F.col("text"))).alias("not_canonical"), n(F.col("n_chars") != F.length("text")).alias("wrong_length"),
        n(~F.col("lang").isin("en", "de", "fr", "es")).alias("unknown_lang"), F.count("*").alias("rows"),
    )


#: What each conversation is asked of its turns, by their number modulo 3; unit 7 is never there.
RELATIONS = [("BEFORE", 0, 1), ("BEFORE", 2, 0), ("AFTER", 0, 2), ("OVERLAP", 1, 2), ("NEAR", 0, 2), ("AT_END", 1, None), ("AT_END", 7, None), ("NEAR", 0, 7)]


@query(with_views("segments", """, u AS (SELECT video_id, segment_index % 3 AS unit, start_ms FROM segments WHERE status = 'completed'), last AS (SELECT video_id, max(start_ms) AS t FROM u GROUP BY ALL),
  c(relation, subject, object) AS (VALUES """ + ", ".join(f"('{r}', {a}, {'NULL' if b is None else b})" for r, a, b in RELATIONS) + """),
  p AS (SELECT x.video_id, c.*, bool_or(CASE c.relation WHEN 'BEFORE' THEN x.start_ms <= y.start_ms WHEN 'AFTER' THEN x.start_ms >= y.start_ms ELSE abs(x.start_ms - y.start_ms) <= 5000 END) AS holds
    FROM c JOIN u x ON x.unit = c.subject JOIN u y ON y.unit = c.object AND y.video_id = x.video_id GROUP BY ALL),
  z AS (SELECT video_id, c.*, max(start_ms) = any_value(t) AS holds FROM c JOIN u ON unit = subject JOIN last USING (video_id) WHERE relation = 'AT_END' GROUP BY ALL)
  SELECT last.video_id, c.relation, c.subject, c.object, coalesce(p.holds, z.holds) AS holds FROM last, c
  LEFT JOIN p ON p.video_id = last.video_id AND p.relation = c.relation AND p.subject = c.subject AND p.object = c.object
  LEFT JOIN z ON z.video_id = last.video_id AND z.relation = c.relation AND z.subject = c.subject"""))
def relation_satisfaction(spark: SparkSession, d: str) -> DataFrame:
    """Constraints between the turns of a conversation: held by any pair of times, or not, or unknown."""
    u = views.segments(spark, d).where("status = 'completed'").select("video_id", F.expr("cast(segment_index % 3 as int)").alias("unit"), "start_ms")
    told = spark.createDataFrame(RELATIONS, "relation string, subject int, object int")
    given = u.select("video_id").distinct().join(F.broadcast(told), F.lit(True))  # eight rows
    return evidence.relation_outcomes(u, given, ["video_id"], ["video_id"], "unit", "start_ms", 5000).drop("times")


# ---- smaller operators


@query(with_views("evidence", " SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS position, ocr_text FROM base JOIN ocr USING (frame_id) WHERE quality >= 0.3 AND trim(ocr_text) <> ''"))
def evidence_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Usable evidence of known frames, with dense positions in order of id: ranges by id, offsets of ranges."""
    base, _, ocr, _ = views.evidence(spark, d)
    rows = base.join(ocr, "frame_id").where("quality >= 0.3 and trim(ocr_text) <> ''").select("frame_id", "ocr_text", F.expr("frame_id div 1000").alias("range"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of ids
    offsets = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("range").orderBy("frame_id"))
    return rows.withColumn("place", place).join(offsets, "range").select("frame_id", (F.col("before") + F.col("place") - 1).alias("position"), "ocr_text")


@query(with_views("frames", """ SELECT count(*) AS rows, count(*) - count(DISTINCT frame_id) AS repeated_ids, count(*) - count(DISTINCT frame_id) AS repeated_positions, 0::BIGINT AS negative_positions, max(frame_id) + 1 - count(*) AS position_gap,
  count(DISTINCT len(embedding)) AS dimensions, count(*) FILTER (WHERE abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.0011) AS not_unit FROM frames"""))
def index_validation(spark: SparkSession, d: str) -> DataFrame:
    return vector.index_problems(views.frames(spark, d).withColumn("embedding_index", F.col("frame_id")))


@query(with_views("detections", """, c AS (SELECT video_id, day, label, count(*) AS n FROM detections GROUP BY ALL) SELECT video_id, day, label, i AS nth FROM (SELECT *, unnest(generate_series(1, least(n, 3))) AS i FROM c)
  UNION ALL SELECT video_id, day, '__unlisted__', i FROM (SELECT video_id, day, unnest(generate_series(1, m::BIGINT)) AS i FROM (SELECT video_id, day, sum(n - least(n, 3)) AS m FROM c GROUP BY video_id, day))"""))
def counts_expansion(spark: SparkSession, d: str) -> DataFrame:
    """A row for each counted object, three of a label at most; the remainder unlisted."""
    c = views.detections(spark, d).groupBy("video_id", "day", "label").agg(F.count("*").alias("n")).withColumn("shown", F.least("n", F.lit(3)))
    listed = c.select("video_id", "day", "label", F.explode(F.sequence(F.lit(1).cast("long"), F.col("shown"))).alias("nth"))
    rest = c.groupBy("video_id", "day").agg(F.sum(F.col("n") - F.col("shown")).alias("m")).where("m > 0")
    return listed.unionByName(rest.select("video_id", "day", F.lit("__unlisted__").alias("label"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("nth")))


@query("SELECT page_id AS frame_id, url AS image_path, 25.0::DOUBLE AS fps, NOT contains(url, '..') AND starts_with(url, 'http') AS contained, 640 AS width FROM pages")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    ok = ~F.col("url").contains("..") & F.col("url").startswith("http")
    return views.read(spark, d, "pages").select(F.col("page_id").alias("frame_id"), F.col("url").alias("image_path"), F.lit(25.0).alias("fps"), ok.alias("contained"), F.lit(640).alias("width"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN event_id % 10 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k, CASE WHEN event_id % 10 = 0 THEN 'InvalidJson: x' || left(props, 20) END AS error FROM events")
def error_isolating_map(spark: SparkSession, d: str) -> DataFrame:
    """A row that does not parse is a failed row; the others go on."""
    given = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props"))
    k = F.from_json(given, "k long", {"mode": "PERMISSIVE"})["k"]
    e = views.read(spark, d, "events").select("event_id", given.alias("given"), k.alias("k"))
    failed = F.col("k").isNull()
    return e.select("event_id", F.when(failed, "failed").otherwise("completed").alias("status"), "k", F.when(failed, F.concat(F.lit("InvalidJson: "), F.substring("given", 1, 21))).alias("error"))


@query("SELECT vec_id, round(greatest(0, least(1, list_min([embedding[1], embedding[3], embedding[5], embedding[7]])))::DOUBLE, 6) AS x0, round(greatest(0, least(1, list_max([embedding[1], embedding[3], embedding[5], embedding[7]])))::DOUBLE, 6) AS x1 FROM embeddings")
def clamped_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A four-cornered region as an upright box within the picture."""
    xs = F.array(*[F.col("embedding")[i].cast("double") for i in (0, 2, 4, 6)])
    return views.read(spark, d, "embeddings").select("vec_id", F.round(numeric.clamp(F.array_min(xs)), 6).alias("x0"), F.round(numeric.clamp(F.array_max(xs)), 6).alias("x1"))


@query("SELECT d.source, count(*) AS frames, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def coverage_validation(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = views.read(spark, d, "documents").select("doc_id", "source"), views.read(spark, d, "labels").select("doc_id", F.lit(1).alias("h"))
    j = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("frames"), F.count("h").alias("covered"))
    return j.withColumn("missing", F.col("frames") - F.col("covered"))


@query("SELECT conv_id, role, string_agg(text, ' | ' ORDER BY turn) AS evidence FROM conversations GROUP BY ALL")
def evidence_concat(spark: SparkSession, d: str) -> DataFrame:
    c = views.read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("t")))).alias("x"))
    return c.select("conv_id", "role", F.array_join("x.t", " | ").alias("evidence"))


@query(with_views(_HITS, " SELECT h.query_id, count(*) AS cells, count(*) FILTER (WHERE h.frame_id % 6 = 0) AS wrong FROM hits h JOIN frames f USING (frame_id) GROUP BY h.query_id"))
def matrix_identity(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a score matrix against the frames; every sixth cell names the frame after its own."""
    told = F.col("frame_idx") + (F.col("frame_id") % 6 == 0).cast("int")
    h = hits(spark, d).withColumn("frame_idx", told)
    f = views.frames(spark, d).select("frame_id", F.col("video_id").alias("v"), F.col("frame_idx").alias("i"))
    return h.join(f, "frame_id").groupBy("query_id").agg(F.count("*").alias("cells"), F.sum(((F.col("v") != F.col("video_id")) | (F.col("i") != F.col("frame_idx"))).cast("long")).alias("wrong"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS segment_index, (turn * 16000 * 1000) // 44100 AS offset_ms FROM conversations WHERE trim(text) <> '' AND role <> 'system'")
def speech_segments(spark: SparkSession, d: str) -> DataFrame:
    """Non-empty speech, numbered densely; sample offsets as milliseconds."""
    c = views.read(spark, d, "conversations").where("trim(text) <> '' and role <> 'system'")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    return c.select("conv_id", "turn", place.cast("long").alias("segment_index"), F.expr("(turn * 16000 * 1000) div 44100").alias("offset_ms"))


@query(with_views("detections", ", c AS (SELECT video_id, day, label, count(*) AS n FROM detections GROUP BY ALL) SELECT video_id, day, '{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY label) || '}' AS counts_json FROM c GROUP BY ALL"))
def counts_json(spark: SparkSession, d: str) -> DataFrame:
    c = views.detections(spark, d).groupBy("video_id", "day", "label").agg(F.count("*").alias("n"))
    m = c.groupBy("video_id", "day").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("m"))
    return m.select("video_id", "day", F.to_json("m").alias("counts_json"))


@query("""WITH t AS (SELECT event_id // 4 AS request, value, CASE event_id % 4 WHEN 0 THEN 'fusion' WHEN 1 THEN 'search' WHEN 2 THEN 'search' ELSE event_type END AS stage FROM events)
  SELECT stage, count(DISTINCT request) AS requests, round(sum(value), 3) AS total_ms, round(max(value), 6) AS slowest_ms FROM t WHERE stage IN ('search', 'fusion', 'click') GROUP BY stage""")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    """Traces of requests: a ranking, searches of two branches under one name, and a stage of their own; how long three of
    them took, whatever branch they are of and whether they have the present name."""
    e = views.read(spark, d, "events").select(F.expr("event_id div 4").alias("request"), F.col("value").alias("duration_ms"), "event_type", (F.col("event_id") % 4).alias("at"))
    stage = lambda at, name: e.where(F.col("at") == at).withColumn("stage", name)
    own = stage(0, F.lit("ranking")).unionByName(stage(3, F.col("event_type")))
    all_ = traces.merged({"": own, "global": stage(1, F.lit("retrieval")), "local.near": stage(2, F.lit("search"))})
    return traces.durations(all_, ["retrieval", "fusion", "click"])
