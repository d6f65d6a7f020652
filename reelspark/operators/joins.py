"""Joins on time: interval overlap, nearest in time, neighbours, largest overlap; validated equi-joins and key contracts.

Interval joins are equi-joins on the video and a time bin: an interval is repeated for each bin it touches, a pair is kept
only in the first bin both touch, so no pair is made twice, and a long video is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _bins(start: Column, end: Column, width: int) -> Column:
    """The bins that the half-open interval [start, end) touches; none where it is empty."""
    return F.when(end > start, F.sequence(F.floor(start / width), F.floor((end - 1) / width))).otherwise(F.array().cast("array<bigint>"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int = 60_000, how: str = "inner") -> DataFrame:
    """Rows of ``left`` (key, l_start, l_end, ...) and ``right`` (key, r_start, r_end, ...) whose half-open intervals
    overlap.  ``how`` is inner or left; on left, ``left`` needs a unique column ``l_id``."""
    a = left.withColumn("_bin", F.explode(_bins(F.col("l_start"), F.col("l_end"), width)))
    b = right.withColumn("_bin", F.explode(_bins(F.col("r_start"), F.col("r_end"), width)))
    first = F.floor(F.greatest("l_start", "r_start") / width)
    met = a.join(b, [key, "_bin"]).where(
        (F.col("r_start") < F.col("l_end")) & (F.col("r_end") > F.col("l_start")) & (F.col("_bin") == first)
    ).drop("_bin")
    if how == "inner":
        return met
    return left.join(met.drop(*[c for c in left.columns if c != "l_id"]), "l_id", "left")


def nearest_frame(segments: DataFrame, frames: DataFrame, max_gap: int, width: int = 60_000) -> DataFrame:
    """Each segment (video_id, segment_id, start_ms, end_ms) with one frame (frame_id, frame_idx, timestamp_ms): a frame
    inside [start, end), however far from the middle, before any within ``max_gap`` of it; then by distance from the
    middle (start + end) div 2, time, index and id.  Segments without such a frame are left out."""
    mid = F.expr("(start_ms + end_ms) div 2")
    reach = segments.withColumn("mid", mid).select(
        "video_id",
        "segment_id",
        "start_ms",
        "end_ms",
        "mid",
        F.least("start_ms", F.col("mid") - max_gap).alias("l_start"),
        (F.greatest(F.col("end_ms") - 1, F.col("mid") + max_gap) + 1).alias("l_end"),
    )
    points = frames.select(
        "video_id", "frame_id", "frame_idx", "timestamp_ms", F.col("timestamp_ms").alias("r_start"), (F.col("timestamp_ms") + 1).alias("r_end")
    )
    met = overlap_join(reach, points, "video_id", width)
    met = met.withColumn("distance", F.abs(F.col("timestamp_ms") - F.col("mid")))
    met = met.withColumn("inside", (F.col("timestamp_ms") >= F.col("start_ms")) & (F.col("timestamp_ms") < F.col("end_ms")))
    met = met.where(F.col("inside") | (F.col("distance") <= max_gap))
    # a minimum, combined before the shuffle, rather than a sorted window
    best = F.min(F.struct((~F.col("inside")).alias("outside"), "distance", "timestamp_ms", "frame_idx", "frame_id")).alias("b")
    return met.groupBy("video_id", "segment_id").agg(best).select(
        "video_id", "segment_id", "b.frame_id", "b.distance", (~F.col("b.outside")).alias("inside"), "b.timestamp_ms"
    )


def neighbours(frames: DataFrame, window: int, include_self: bool = False) -> DataFrame:
    """Pairs (frame_id, other_id, gap_ms) of one video whose times differ by at most ``window``."""
    width = max(1, window)
    a = frames.select("video_id", "frame_id", "timestamp_ms", F.explode(F.array(*[F.floor(F.col("timestamp_ms") / width) + i for i in (-1, 0, 1)])).alias("_bin"))
    b = frames.select("video_id", F.col("frame_id").alias("other_id"), F.col("timestamp_ms").alias("other_ms"), F.floor(F.col("timestamp_ms") / width).alias("_bin"))
    met = a.join(b, ["video_id", "_bin"]).where(F.abs(F.col("timestamp_ms") - F.col("other_ms")) <= window)
    met = met if include_self else met.where("frame_id <> other_id")
    return met.select("frame_id", "other_id", (F.col("other_ms") - F.col("timestamp_ms")).alias("gap_ms"))


def speaker_of(segments: DataFrame, turns: DataFrame, width: int = 60_000) -> DataFrame:
    """Each segment with the speaker of the largest overlap, the larger name among equals; null where none overlaps."""
    a = segments.withColumnsRenamed({"start_ms": "l_start", "end_ms": "l_end"})
    b = turns.withColumnsRenamed({"start_ms": "r_start", "end_ms": "r_end"})
    met = overlap_join(a, b, "video_id", width)
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    best = met.groupBy("segment_id").agg(F.max(F.struct(shared.alias("overlap_ms"), "speaker")).alias("b"))
    return segments.join(best, "segment_id", "left").select("segment_id", "b.speaker", "b.overlap_ms")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row of violation counts of a left join on ``keys`` that should be one to one and complete."""
    repeated = lambda df: df.groupBy(*keys).count().where("count > 1")
    parts = {
        "unmatched": left.join(right, keys, "left_anti"),
        "unused": right.join(left, keys, "left_anti"),
        "left_repeated": repeated(left),
        "right_repeated": repeated(right),
    }
    rows = None
    for name, df in parts.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("contract"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def union_merge(ranked: DataFrame) -> DataFrame:
    """Sources of one frame merged into a row: lists by source name of scores and ranks, and whether one source has it
    twice (an error to callers)."""
    entry = F.struct("source", "rank", "score")
    return ranked.groupBy("query_id", "frame_id").agg(
        F.sort_array(F.collect_list(entry)).alias("entries"), (F.count("*") > F.countDistinct("source")).alias("repeated")
    ).select(
        "query_id",
        "frame_id",
        F.transform("entries", lambda e: e["source"]).alias("sources"),
        F.transform("entries", lambda e: e["rank"]).alias("ranks"),
        "repeated",
    )


def in_order_of(ids: list, rows: DataFrame, key: str) -> DataFrame:
    """Rows looked up by a list of ids, in its order, repeated where it repeats, with ``position``."""
    wanted = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"position int, {key} {rows.schema[key].dataType.simpleString()}")
    return rows.join(wanted, key)  # Spark knows the list's size, and broadcasts a short one


def rank_pairs(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """The n-th row of a group on the left with the n-th on the right."""
    place = lambda df, c: df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(c)))
    return place(left, left_order).join(place(right, right_order), [group, "place"], "full")


def every_pair(left: DataFrame, right: DataFrame, blocks: int = 16) -> DataFrame:
    """Every row of one key set with every row of another.  The right set is dealt into blocks, each left row meets every
    block, so that the pairs of one row spread over tasks and neither set is broadcast."""
    a = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = right.withColumn("_b", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int"))
    return a.join(b, "_b").drop("_b")
