"""Mixing sources to target weights by systematic sampling.

A source's target is its share of the mix, by weight, up to a largest number of repeats.  Each of its documents then has
the same expected number of copies, target / size of the source.  The documents stand in order of size within the source;
their expected copies are summed up, one random offset is added, and a document is taken once for each whole number that
the sum crosses at it.  In order of size the words taken differ from the target by less than one longest document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """From (source, source_size), one row a source: those and target.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes.  A target stops at
    ``most`` times its source's size; the excess is shared again by weight.  In order of size per weight the stopped
    sources come first, so running sums give the common level in one pass."""
    order = W.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", most * F.col("source_size"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    leveled = (
        weighed.withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("place", F.row_number().over(by_level))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # the first source that its level does not fill, and all after it, take that level
    held = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))
    common_level = F.min(held).over(everything)["level"]
    return leveled.withColumn("target", F.least("cap", F.coalesce(common_level * F.col("weight"), F.col("cap")))).select(
        "source", "source_size", "target"
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: doc_id, size (words), source_size, target (its source's), taken (words that the mix takes of
    it, repeats counted), copies.

    The offset of a source is drawn from ``seed`` and its name, so runs agree.  A null text has no words and is taken in
    turn like others, for 0 words.  A null source is a source.  Ties of size are taken in order of id; repeated rows are
    documents each.  Other columns are ignored; an empty table gives no rows."""
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    placed = common.table(common.numbered(rows, [F.col("size"), F.col("doc_id")], "ranked", per="source"), "placed")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sizes, weights, share, most).withColumnRenamed("source", "_source")
    drawn = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "source")), 1, 5)
    offset = F.conv(drawn, 16, 10).cast("double") / F.lit(float(16**5))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((F.col("position") + 1) * rate + offset) - F.floor(F.col("position") * rate + offset)
    joined = placed.join(wanted, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.least(crossed, F.lit(math.floor(most))).cast("long")
    return joined.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies")
    )


def oracle(weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    return f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
wt AS (SELECT *, {list(weights)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1]::DOUBLE AS weight, {most}::DOUBLE * source_size AS cap FROM src),
lv AS (SELECT *, ({share}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER w AS place FROM wt WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
tg AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM lv WHERE level * weight < cap) * weight, cap)) AS target FROM lv),
p AS (SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) - 1 AS position,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || left(md5(concat_ws(':', '{seed}', s.source)), 5))::INTEGER / {16**5}.0::DOUBLE AS draw
  FROM s JOIN tg ON s.source IS NOT DISTINCT FROM tg.source),
c AS (SELECT *, least(floor((position + 1) * rate + draw) - floor(position * rate + draw), {int(most)})::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c"""
