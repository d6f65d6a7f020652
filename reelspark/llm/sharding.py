"""Sharding by fixed virtual slots.

Every record is hashed into one of a fixed number of slots, thousands of them.  Bytes are added up per slot, and a
versioned map, a table of (version, slot, shard), says which shard holds a slot.  Version 1 deals slots out in turn;
rebalancing edits the last version: it moves slots from the fullest shard to the emptiest, or exchanges two slots, as long
as the two come closer, and appends the result as the next version.  Records never move alone, and the map, a row for
each slot, is all that the driver handles.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

SLOTS = 4096
MAP = "version int, slot_no int, shard int"


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, slot_no."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    return rows.withColumn("slot_no", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def rebalanced(loads: dict[int, int], owner: dict[int, int], shards: int) -> dict[int, int]:
    """``owner`` (slot to shard) edited until no move or exchange brings the fullest and the emptiest shard closer."""
    owner = dict(owner)
    total = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]  # (load, slot), sorted
    for slot, shard in sorted(owner.items()):
        total[shard] += loads.get(slot, 0)
        if loads.get(slot, 0):
            held[shard].append((loads[slot], slot))
    for h in held:
        h.sort()

    def closest(items: list[tuple[int, int]], want: float) -> tuple[int, int] | None:
        at = bisect_left(items, (want, -1))
        near = [items[i] for i in (at - 1, at) if 0 <= i < len(items)]
        return min(near, key=lambda x: (abs(x[0] - want), x), default=None)

    for _ in range(20 * len(owner)):
        high, low = max(range(shards), key=lambda s: (total[s], s)), min(range(shards), key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        best: tuple[float, tuple[int, int], tuple[int, int] | None] | None = None
        if (x := closest(held[high], gap / 2)) and x[0] < gap:
            best = (abs(gap / 2 - x[0]), x, None)
        for y in held[low]:
            if best and best[0] < 0.5:
                break
            x = closest(held[high], y[0] + gap / 2)
            if x and 0 < x[0] - y[0] < gap and (best is None or abs(gap / 2 - (x[0] - y[0])) < best[0]):
                best = (abs(gap / 2 - (x[0] - y[0])), x, y)
        if best is None:
            break
        _, x, y = best
        for item, source, target in [(x, high, low)] + ([(y, low, high)] if y else []):
            held[source].remove(item)
            held[target].insert(bisect_left(held[target], item), item)
            total[source] -= item[0]
            total[target] += item[0]
            owner[item[1]] = target
    return owner


def slot_map(rows: DataFrame, shards: int, slots: int = SLOTS, previous: DataFrame | None = None) -> DataFrame:
    """The versioned map, as a written table: the versions of ``previous`` (or version 1, slots in turn), and one more,
    rebalanced by the bytes of ``rows`` (from ``slotted``).  With more shards than before, new ones start empty."""
    spark = rows.sparkSession
    if previous is None:
        versions = [(1, s, s % shards) for s in range(slots)]
    else:
        versions = [(r.version, r.slot_no, r.shard) for r in previous.collect()]  # a row for each slot and version
    last = max(v for v, _, _ in versions)
    owner = {slot: shard for v, slot, shard in versions if v == last}
    loads = {r.slot_no: r.load for r in rows.groupBy("slot_no").agg(F.sum("size").alias("load")).collect()}
    versions += [(last + 1, slot, shard) for slot, shard in sorted(rebalanced(loads, owner, shards).items())]
    return common.table(spark.createDataFrame(versions, MAP), "slot-map")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law ("bytes"), shard, slot (its place in the shard, gapless from
    0), grown_shard (null: growing edits the map by bytes), slot_no (the virtual slot), map_version.

    A null text has no bytes: size 1, crc of nothing.  A null id hashes as any other value; rows of one id and text share
    a virtual slot.  Equal texts of different ids are different records: a group of copies is spread over slots, so that it
    can't fill a shard.  Other columns are ignored; an empty table gives no rows."""
    rows = common.table(slotted(docs, slots, id_col, text_col), "slotted")
    versions = slot_map(rows, shards, slots)
    newest = versions.groupBy("slot_no").agg(F.max_by("shard", "version").alias("shard"), F.max("version").alias("map_version"))
    counts = rows.groupBy("slot_no").agg(F.count("*").alias("n")).join(F.broadcast(newest), "slot_no")
    before = W.partitionBy("shard").orderBy("slot_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # at most SLOTS rows
    place = F.row_number().over(W.partitionBy("slot_no").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("place", place).join(F.broadcast(offsets), "slot_no")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "slot_no",
        "map_version",
    )
