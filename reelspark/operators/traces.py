"""Traces of requests: the stages of several branches under one another's names, and how long they took."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that stages had before, and have now.
ALIASES = {"retrieval": "search", "ranking": "fusion"}


def merged(branches: dict[str, DataFrame]) -> DataFrame:
    """(request, stage, duration_ms) of all branches, a stage's name after its branch's ("" keeps it as it is).  A request
    that has a stage twice is an error."""
    out = None
    for branch, rows in branches.items():
        name = F.concat(F.lit(f"{branch}."), "stage") if branch else F.col("stage")
        rows = rows.select("request", name.alias("stage"), "duration_ms")
        out = rows if out is None else out.unionByName(rows)
    once = out.groupBy("request", "stage").agg(F.count("*").alias("_n"), F.max("duration_ms").alias("duration_ms"))
    twice = F.raise_error(F.concat(F.lit("the stage "), "stage", F.lit(" is there twice")))
    return once.select("request", "stage", F.when(F.col("_n") > 1, twice).otherwise(F.col("duration_ms")).alias("duration_ms"))


def durations(traces: DataFrame, stages: list[str]) -> DataFrame:
    """stage, requests, total_ms, slowest_ms of each of some stages, by the end of their names, whichever branch they are of,
    under their present name or an earlier one."""
    last = F.element_at(F.split("stage", r"\."), -1)
    now = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), last), last)
    rows = traces.withColumn("stage", now).where(F.col("stage").isin([ALIASES.get(s, s) for s in stages]))
    total = F.round(F.sum("duration_ms"), 3).alias("total_ms")
    return rows.groupBy("stage").agg(F.count_distinct("request").alias("requests"), total, F.round(F.max("duration_ms"), 6).alias("slowest_ms"))
