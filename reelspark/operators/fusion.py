"""Fusing ranked lists of several sources: reciprocal ranks, weights, shortlists, orders."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def union_sources(lists: dict[str, DataFrame]) -> DataFrame:
    """(query_id, source, frame_id, score, rank) of several sources; a frame has at most one row for each source."""
    out = None
    for source, df in lists.items():
        rows = df.select("query_id", F.lit(source).alias("source"), "frame_id", "score", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


def active_weights(configured: dict[str, float], active: set[str], required: set[str] = frozenset()) -> dict[str, float]:
    """Weights of the sources that answered, scaled so that they add up to what all of them would.  Without a required
    source there is no answer; the loss of another one is a warning."""
    if lost := sorted(required - active):
        raise ValueError(f"required sources failed: {', '.join(lost)}")
    if lost := sorted(set(configured) - active):
        warnings.warn(f"sources failed: {', '.join(lost)}", stacklevel=2)
    left = {s: w for s, w in configured.items() if s in active}
    scale = sum(configured.values()) / sum(left.values()) if left and len(left) < len(configured) else 1.0
    return {s: w * scale for s, w in left.items()}


def reciprocal_rank(ranked: DataFrame, weights: dict[str, float], k: int = 60, top: int | None = None) -> DataFrame:
    """(query_id, frame_id, fusion_score, best_rank, sources, rank): ranks count from 1; order by score, best rank, id."""
    weight = F.element_at(F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))]), F.col("source"))
    fused = ranked.where(F.col("source").isin(*weights)).groupBy("query_id", "frame_id").agg(
        F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("fusion_score"),
        F.min("rank").alias("best_rank"),
        F.count("*").alias("sources"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc("fusion_score"), "best_rank", "frame_id")
    fused = fused.withColumn("rank", F.row_number().over(order))
    return fused.where(F.col("rank") <= top) if top else fused


def video_shortlist(hits: DataFrame, event: str, k: int = 60, top: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, video_id, coverage, votes, place): of each event the first hit in each video, whose rank counts from 0; the
    videos of each ``by`` by coverage, votes and id."""
    first = hits.groupBy(*by, event, "video_id").agg((F.min("rank") - 1).alias("rank0"))
    votes = first.groupBy(*by, "video_id").agg(F.count("*").alias("coverage"), F.round(F.sum(1.0 / (k + F.col("rank0"))), 9).alias("votes"))
    order = [F.desc("coverage"), F.desc("votes"), F.col("video_id")]
    if not by:  # without a key rows are limited before they meet in one task
        votes = votes.orderBy(*order).limit(top) if top else votes
    placed = votes.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return placed.where(F.col("place") <= top) if top else placed


def calibrated(ranked: DataFrame, gold: DataFrame, configurations: list[dict[str, float]], cutoffs: tuple[int, ...] = (1, 5, 20, 50, 100), k: int = 60, asked: DataFrame | None = None) -> DataFrame:
    """How well weights of the sources find gold frames: (config, weights, score, place), the best first.

    ``ranked`` has (query_id, source, frame_id, rank), ``gold`` (query_id, frame_id); queries with gold count, or those
    of ``asked`` (query_id), where ``gold`` has no more than the pairs that were ranked.  For each
    of ``configurations`` the candidates of a query are fused anew, by weight / (k + rank) and then by id; the score is
    the mean over queries and cut-offs of whether a gold frame is among the first.  Equal scores go to the weights that
    are smaller in the order of the sources."""
    sources = sorted({s for c in configurations for s in c})
    at = {s: F.max(F.when(F.col("source") == s, F.col("rank"))).alias(f"rank_{i}") for i, s in enumerate(sources)}
    merged = ranked.groupBy("query_id", "frame_id").agg(*at.values())
    grid = F.array(*[F.struct(F.lit(n).alias("config"), *[F.lit(float(c.get(s, 0.0))).alias(f"w_{i}") for i, s in enumerate(sources)]) for n, c in enumerate(configurations)])
    each = merged.withColumn("g", F.explode(grid)).select("query_id", "frame_id", *[f"rank_{i}" for i in range(len(sources))], "g.*")
    fused = sum((F.coalesce(F.col(f"w_{i}") / (k + F.col(f"rank_{i}")), F.lit(0.0)) for i in range(len(sources))), F.lit(0.0))
    place = F.row_number().over(W.partitionBy("config", "query_id").orderBy(F.desc(F.round("fused", 12)), "frame_id"))
    placed = each.withColumn("fused", fused).withColumn("place", place)
    hit = placed.join(gold.select("query_id", "frame_id").distinct(), ["query_id", "frame_id"], "left_semi")
    first = hit.groupBy("config", "query_id").agg(F.min("place").alias("first"))
    weights = [f"w_{i}" for i in range(len(sources))]
    asked = (gold if asked is None else asked).select("query_id").distinct().withColumn("g", F.explode(grid)).select("query_id", "g.*")
    found = sum(((F.col("first") <= c).cast("double") for c in cutoffs), F.lit(0.0)) / len(cutoffs)
    scores = asked.join(first, ["config", "query_id"], "left").groupBy("config", *weights).agg(F.round(F.avg(F.coalesce(found, F.lit(0.0))), 9).alias("score"))
    scores = scores.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), *weights, "config")))  # a row for each configuration
    return scores.select("config", F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.col(f"w_{i}"))]).alias("weights"), "score", "place")


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order, which should be total."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their place; Spark limits groups before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def submissions(ranked: DataFrame, frames: DataFrame, top: int = 100) -> DataFrame:
    """query_id, video_id, frame_idx, frame_id, answer, rank: the rows to hand in for ranked answers (query_id, frame_id,
    video_id, answer, rank).  Answers that name no known frame, or one of another video than their own, are passed over; of
    those of one video, frame number and answer the first counts; ranks are counted anew, up to ``top`` (1 to 100)."""
    if not 1 <= top <= 100:
        raise ValueError("top must be 1 to 100")
    known = ranked.join(frames.select("frame_id", "video_id", "frame_idx"), ["frame_id", "video_id"])
    once = known.groupBy("query_id", "video_id", "frame_idx", "answer").agg(F.min(F.struct("rank", "frame_id")).alias("first"))
    rows = once.select("query_id", "video_id", "frame_idx", "first.frame_id", "answer", F.col("first.rank").alias("_was"))
    return top_per(rows, ["query_id"], [F.col("_was")], top).drop("_was")
