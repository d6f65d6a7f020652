"""Aggregates of evidence: object summaries, text merging, video and scene scores, answer ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as strings


def object_summary(detections: DataFrame, keys: list[str], least: float, top: int) -> DataFrame:
    """keys, summary ("label xN; ..."), detection_count: labels of enough confidence by count, confidence, name."""
    each = detections.where(F.col("confidence") >= least).groupBy(*keys, "label").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
    order = F.struct((-F.col("n")).alias("less"), (-F.col("best")).alias("worse"), "label", "n")
    listed = each.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("x"), F.sum("n").alias("detection_count"))
    entry = F.transform(F.slice("x", 1, top), lambda e: F.concat(e["label"], F.lit(" x"), e["n"].cast("string")))
    return listed.select(*keys, F.array_join(entry, "; ").alias("summary"), "detection_count")


def distinct_text(rows: DataFrame, keys: list[str], order: str, text: str, glue: str = " ") -> DataFrame:
    """Texts of a group, composed, joined in order, each (without case and runs of blanks) once, where it came first."""
    rows = rows.withColumn("_t", strings.nfc_collapse(F.col(text))).where("_t <> ''")
    first = rows.withColumn("_k", strings.composed(F.col("_t"), fold=True)).groupBy(*keys, "_k").agg(F.min(F.struct(order, "_t")).alias("f"))
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list("f")).alias("x"))
    return listed.select(*keys, F.array_join("x._t", glue).alias("text"), F.size("x").cast("long").alias("parts"))


def region_quality(regions: DataFrame, least: float) -> DataFrame:
    """frame_id, kept, total, quality: min(1, kept / total * mean confidence), the mean over all scored regions."""
    usable = (F.coalesce("confidence", F.lit(1.0)) >= least) & F.col("text").rlike(r"[\p{L}\p{N}]")
    each = regions.groupBy("frame_id").agg(
        F.count_distinct(F.when(usable, F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))).alias("kept"),
        F.count("*").alias("total"),
        F.coalesce(F.round(F.avg("confidence"), 12), F.lit(1.0)).alias("mean"),
    )
    return each.select("frame_id", "kept", "total", F.round(F.least(F.lit(1.0), F.col("kept") / F.col("total") * F.col("mean")), 9).alias("quality"))


def bounds(evidence: DataFrame, *unit: str) -> DataFrame:
    """unit, low, high over each unit's best score in each video; low is at most 0."""
    best = evidence.groupBy(*unit, "video_id").agg(F.max("score").alias("best"))
    return best.groupBy(*unit).agg(F.least(F.lit(0.0), F.min("best")).alias("low"), F.max("best").alias("high"))


def scaled(score: Column, low: Column, high: Column) -> Column:
    """A score between bounds as 0 to 1; 1 where the bounds meet."""
    return F.when(high <= low, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - low) / (high - low))))


def video_scores(evidence: DataFrame, evaluated: DataFrame, task: str, unit: str, units: int | str, weights: tuple[float, float, float] = (0.45, 0.25, 0.30)) -> DataFrame:
    """task, video_id, semantic, matched, evaluated, score of the videos that a task's units have seen: the mean of scaled
    maxima of matched units, the share of evaluated units that match times the share of units that were evaluated, and the
    latter; all three weights always count.  ``units`` is a task's number of units, or the column of ``evaluated`` that has
    it."""
    keys = [task, "video_id"]
    best = evidence.groupBy(*keys, unit).agg(F.max("score").alias("best")).join(bounds(evidence, task, unit), [task, unit])
    semantic = best.groupBy(*keys).agg(F.round(F.avg(scaled(F.col("best"), F.col("low"), F.col("high"))), 9).alias("semantic"), F.count("*").alias("matched"))
    number = F.max(units) if isinstance(units, str) else F.lit(units)
    seen = evaluated.groupBy(*keys).agg(F.count_distinct(unit).alias("evaluated"), number.alias("_units"))
    joined = seen.join(semantic, keys, "left").fillna(0, ["matched"]).fillna(0.0, ["semantic"])
    a, b, c = weights
    score = (a * F.col("semantic") + b * F.col("matched") / F.col("_units") + c * F.col("evaluated") / F.col("_units")) / (a + b + c)
    return joined.select(*keys, "semantic", "matched", "evaluated", F.round(score, 12).alias("score"))


#: The terms of an answer's score.
ANSWER_TERMS = ("video", "frame", "grounding", "answer", "consistency")


def answer_ranking(answers: DataFrame, question: str, weights: tuple[float, ...] = (0.2, 0.2, 0.2, 0.2, 0.2)) -> DataFrame:
    """Grounded answers of a question with joint_score and place: the weighted sum of ANSWER_TERMS, each scaled between its
    least and its greatest over the question (a constant one counts as 1).

    ``answers`` has question, answer_key, grounded, video_score, frame_score, localization, coverage, confidence, and
    video_id, start_ms, frame_id for ties.  An answer that is not grounded, or empty, takes no part.  Grounding is half
    localization and half coverage; consistency is the share of the answers that say the same."""
    whole, same = W.partitionBy(question), W.partitionBy(question, "answer_key")
    valid = answers.where("grounded and answer_key is not null and answer_key <> ''").withColumns(
        {
            "_video": F.col("video_score"),
            "_frame": F.col("frame_score"),
            "_grounding": 0.5 * F.col("localization") + 0.5 * F.col("coverage"),
            "_answer": F.col("confidence"),
            "_consistency": F.count("*").over(same) / F.count("*").over(whole),
        }
    )
    total = F.lit(0.0)
    for term, weight in zip(ANSWER_TERMS, weights):
        x = F.col(f"_{term}")
        low, high = F.min(x).over(whole), F.max(x).over(whole)
        total = total + weight * F.when(high > low, (x - low) / (high - low)).otherwise(1.0)
    scored = valid.withColumn("consistency", F.col("_consistency")).withColumn("joint_score", F.round(total, 9))
    order = [F.desc("joint_score"), F.desc("confidence"), *map(F.col, ("video_id", "start_ms", "frame_id", "answer_key"))]
    return scored.withColumn("place", F.row_number().over(whole.orderBy(*order))).drop(*[f"_{t}" for t in ANSWER_TERMS])


def _nearest_times(evidence: DataFrame, wanted: DataFrame, keys: list[str], by: list[str], unit: str, time: str) -> DataFrame:
    """keys, subject, object, apart: the least distance between a time of the one unit and a time of the other.  Both units'
    times are put in one order, where the nearest of the other kind is the last one before; no pair is made."""
    pairs = wanted.select(*by, "subject", "object").distinct()
    of = lambda side, code: evidence.join(pairs.withColumn(unit, F.col(side)), [*by, unit]).select(*keys, "subject", "object", F.col(time).alias("_t"), F.lit(code).alias("_side"))
    rows = of("subject", 0).unionByName(of("object", 1))
    so_far = W.partitionBy(*keys, "subject", "object").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    last = lambda code: F.max(F.when(F.col("_side") == code, F.col("_t"))).over(so_far)
    other = F.when(F.col("_side") == 0, last(1)).otherwise(last(0))
    return rows.withColumn("_gap", F.col("_t") - other).groupBy(*keys, "subject", "object").agg(F.min("_gap").alias("apart"))


def relation_outcomes(evidence: DataFrame, constraints: DataFrame, keys: list[str], by: list[str], unit: str, time: str, near_ms: int) -> DataFrame:
    """keys, relation, subject, object, times (how often the constraint is given), holds: what becomes of every constraint of
    ``by`` (some of the keys) in each scene (keys) with evidence.

    ``constraints`` has by, relation, subject, object, the units it speaks of.  BEFORE and AFTER hold if any pair of the
    subject's and the object's times is in that order (or the same), OVERLAP and NEAR if any is at most ``near_ms`` apart,
    AT_END, which has no object, if the subject's last time is the scene's.  ``holds`` is null (unknown) where the subject
    or a named object has no evidence."""
    spans = evidence.groupBy(*keys, unit).agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    scenes = spans.groupBy(*keys).agg(F.max("t1").alias("_last"))
    given = constraints.groupBy(*by, "relation", "subject", "object").agg(F.count("*").alias("times"))
    named = lambda side, p: spans.select(*keys, F.col(unit).alias(side), F.col("t0").alias(f"{p}0"), F.col("t1").alias(f"{p}1"))
    rows = scenes.join(given, by).join(named("subject", "_s"), [*keys, "subject"], "left").join(named("object", "_o"), [*keys, "object"], "left")
    near = _nearest_times(evidence, given.where("relation in ('OVERLAP', 'NEAR')"), keys, by, unit, time)
    rows = rows.join(near, [*keys, "subject", "object"], "left")
    c = F.col
    holds = (
        F.when(c("relation") == "BEFORE", c("_s0") <= c("_o1"))
        .when(c("relation") == "AFTER", c("_s1") >= c("_o0"))
        .when(c("relation").isin("OVERLAP", "NEAR"), c("apart") <= near_ms)
        .when(c("relation") == "AT_END", c("_s1") == c("_last"))
    )
    unknown = c("_s0").isNull() | (c("object").isNotNull() & c("_o0").isNull())
    # a relation that needs an object and names none is known and doesn't hold
    return rows.select(*keys, "relation", "subject", "object", "times", F.when(~unknown, F.coalesce(holds, F.lit(False))).alias("holds"))


def relation_scores(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, related (the share of known constraints that hold, null if none is known), unknown (how many are not known)."""
    n = lambda c: F.sum(F.when(c, F.col("times")).otherwise(0))
    known = F.col("holds").isNotNull()
    agg = outcomes.groupBy(*keys).agg(n(F.col("holds")).alias("_held"), n(known).alias("_known"), n(~known).alias("unknown"))
    return agg.select(*keys, F.when(F.col("_known") > 0, F.round(F.col("_held") / F.col("_known"), 9)).alias("related"), "unknown")


#: The weights of a scene's semantic, coverage, temporal and relation terms.
SCENE_WEIGHTS = (0.45, 0.30, 0.15, 0.10)


def scene_scores(
    evidence: DataFrame, evaluated: DataFrame, constraints: DataFrame, task: str, unit: str, scene: str, units: int | str,
    scale_ms: int = 15000, weights: tuple[float, float, float, float] = SCENE_WEIGHTS,
) -> DataFrame:
    """A task's scenes (task, video_id, scene) of evidence (with unit, score, timestamp_ms): start and end, semantic (mean of
    scaled maxima of matched units), coverage (share of the video's evaluated units that match in the scene), evaluation
    (share of the task's units that were evaluated in the video), temporal (compactness), related (share of the known
    constraints that hold), unknown, and score: the weighted mean of semantic, coverage times evaluation, temporal, and
    related, where that is known.

    ``evaluated`` has (task, unit, video_id) of all pairs that were looked at, with or without a match; ``constraints``
    (task, relation, subject, object).  ``units`` is a task's number of units, or the column of ``evaluated`` that has it."""
    keys = [task, "video_id", scene]
    best = evidence.groupBy(*keys, unit).agg(F.max("score").alias("best"), F.min("timestamp_ms").alias("t0"), F.max("timestamp_ms").alias("t1"))
    # the bounds of a unit: the least and the greatest of its best in each video
    of_video = F.max("best").over(W.partitionBy(task, unit, "video_id"))
    of_unit = W.partitionBy(task, unit)
    best = best.withColumn("_top", of_video).withColumns({"low": F.least(F.lit(0.0), F.min("_top").over(of_unit)), "high": F.max("_top").over(of_unit)})
    s = best.groupBy(*keys).agg(
        F.round(F.avg(scaled(F.col("best"), F.col("low"), F.col("high"))), 9).alias("semantic"),
        F.count("*").alias("matched"),
        F.min("t0").alias("start_ms"),
        F.max("t1").alias("end_ms"),
    )
    number = F.max(units) if isinstance(units, str) else F.lit(units)
    seen = evaluated.groupBy(task, "video_id").agg(F.count_distinct(unit).alias("evaluated"), number.alias("_units"))
    related = relation_scores(relation_outcomes(evidence, constraints, keys, [task], unit, "timestamp_ms", scale_ms), keys)
    s = s.join(seen, [task, "video_id"]).join(related, keys, "left").fillna(0, ["unknown"])
    s = s.withColumns(
        {
            "coverage": F.col("matched") / F.col("evaluated"),
            "evaluation": F.col("evaluated") / F.col("_units"),
            "temporal": 1.0 / (1.0 + (F.col("end_ms") - F.col("start_ms")) / float(scale_ms)),
        }
    )
    a, b, c, d = weights
    total = a * F.col("semantic") + b * F.col("coverage") * F.col("evaluation") + c * F.col("temporal")
    known = F.when(F.col("related").isNull(), a + b + c).otherwise(a + b + c + d)
    score = F.round((total + F.coalesce(d * F.col("related"), F.lit(0.0))) / known, 12)
    places = {c: F.round(c, 9) for c in ("coverage", "evaluation", "temporal")}
    return s.withColumn("score", score).withColumns(places).drop("matched", "evaluated", "_units")


def scene_order(scenes: DataFrame, task: str, per_video: int = 3, most: int = 100) -> DataFrame:
    """``place`` of a task's scenes by score, semantic, coverage, evaluation, temporal, video, start and name: the best few
    of a video, then of all."""
    order = [*map(F.desc, ("score", "semantic", "coverage", "evaluation", "temporal")), F.col("video_id"), F.col("start_ms"), F.col("scene")]
    best = scenes.withColumn("_n", F.row_number().over(W.partitionBy(task, "video_id").orderBy(*order))).where(F.col("_n") <= per_video)
    return best.drop("_n").withColumn("place", F.row_number().over(W.partitionBy(task).orderBy(*order))).where(F.col("place") <= most)
