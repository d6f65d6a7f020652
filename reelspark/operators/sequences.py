"""Operators on ordered rows of a video: clustering, alignment of ordered events, peaks, thinning, suppression.

What windows express is windows.  Folds, whose next decision depends on earlier ones, run over the rows of one video at a
time, as small functions on arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType


def gap_sessions(rows: DataFrame, keys: list[str], time: str, max_gap: int, tie: str) -> DataFrame:
    """``session`` (from 0): a new one where the time since the row before is more than ``max_gap``."""
    w = W.partitionBy(*keys).orderBy(time, tie)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > max_gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def bounded_clusters(times: np.ndarray, max_gap: int, max_span: int) -> np.ndarray:
    """Cluster numbers of sorted times: a new one at a gap over ``max_gap`` or a span from its start over ``max_span``."""
    out, start, number = np.zeros(len(times), np.int64), None, -1
    for i, t in enumerate(times.tolist()):
        if start is None or t - times[i - 1] > max_gap or t - start > max_span:
            start, number = t, number + 1
        out[i] = number
    return out


def clusters_of_groups(times: np.ndarray, at: np.ndarray, max_gap: int, max_span: int) -> np.ndarray:
    """``bounded_clusters`` of each group of rows; ``at`` is where groups begin, and the end.

    From a cluster's first row the next cluster's is known: after the first gap, or beyond the span.  All groups go on from
    cluster to cluster together, so there are as many steps as the group with most clusters has."""
    n, out = len(times), np.zeros(len(times), np.int64)
    if not n:
        return out
    group = np.repeat(np.arange(len(at) - 1), np.diff(at))
    times = times - times.min()
    cut = np.ones(n + 1, bool)
    cut[1:-1] = (np.diff(times) > max_gap) | (np.diff(group) != 0)
    after = np.flatnonzero(cut)
    after = after[np.searchsorted(after, np.arange(n), side="right")]
    line = group * (int(times.max()) + max_span + 1) + times
    after = np.minimum(after, np.searchsorted(line, line + max_span, side="right"))
    first, number = at[:-1][np.diff(at) > 0], 0
    ends = np.repeat(at[1:], np.diff(at))
    while len(first):
        out[first] = number
        new = after[first]
        first, number = new[new < ends[first]], number + 1
    # the rows between have the number of the last first row before them, which is the greatest of the group so far
    return np.maximum.accumulate(out + group * (number + 1)) - group * (number + 1)


def bounded_scenes(rows: DataFrame, keys: list[str], time: str, max_gap: int, max_span: int, name: str) -> DataFrame:
    """``rows`` with the number of their cluster (``bounded_clusters``) among the rows of their keys in order of time."""
    schema = StructType([*rows.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, keys):
            if table.num_rows:
                made = clusters_of_groups(table[time].to_numpy(), np.asarray(at), max_gap, max_span)
                yield from table.append_column(name, pa.array(made)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, time).mapInArrow(run, schema)


def anchor_clusters(vectors: np.ndarray, delta: float) -> np.ndarray:
    """Cluster numbers of rows in order: a new one where a row is more than ``delta`` (largest component) from the
    cluster's first."""
    out, anchor, number = np.zeros(len(vectors), np.int64), None, -1
    for i, v in enumerate(vectors):
        if anchor is None or np.abs(v - anchor).max() > delta:
            anchor, number = v, number + 1
        out[i] = number
    return out


def align_events(scored: DataFrame, keys: list[str], events: int, penalty: float = 1e-5, paths: int = 1, power: float = 1.0, delta: float = 0.0) -> DataFrame:
    """(keys, path_no, score, frame_ids): for the ``paths`` best last frames of each video (keys), the best choice of one
    frame for each event, strictly forward in time.

    ``scored`` has a row (keys, event, frame_id, timestamp_ms, score) for each of ``events`` events and each frame.  A
    choice's score is the sum of its frames' scores (to the ``power``) less ``penalty`` for each millisecond between the
    first and the last.  With ``delta`` frames whose scores are within it of their cluster's first are one cluster, and a
    choice has one frame of a cluster at most.  Of equal predecessors the latest is taken, of equal last frames the first.
    Fewer frames or clusters than events have no choice.

    A running maximum for each event: the best end of the events so far among all frames before."""
    score = F.pow(F.greatest("score", F.lit(0.0)), F.lit(power)) if power != 1.0 else F.col("score")
    names = [f"s{e}" for e in range(events)]
    each = [F.max(F.when(F.col("event") == e, score)).alias(n) for e, n in enumerate(names)]
    rows = scored.groupBy(*keys, "frame_id", "timestamp_ms").agg(*each).dropna(subset=names)
    order = W.partitionBy(*keys).orderBy("timestamp_ms", "frame_id")
    if delta > 0:
        rows = fold(rows, keys, ["timestamp_ms", "frame_id"], "cluster", "long", lambda p: anchor_clusters(p[names].to_numpy(), delta))
    else:
        rows = rows.withColumn("cluster", F.row_number().over(order).cast("long"))
    before = W.partitionBy(*keys).orderBy("cluster").rangeBetween(W.unboundedPreceding, -1)
    late = penalty * F.col("timestamp_ms")
    rows = rows.withColumns({"value": F.col("s0"), "path": F.array("frame_id")})
    for n in names[1:]:
        end = F.struct((F.col("value") + late).alias("v"), "timestamp_ms", "frame_id", "path")
        rows = rows.withColumn("best", F.max(F.when(F.col("value").isNotNull(), end)).over(before))
        rows = rows.withColumns({"value": F.col(n) - late + F.col("best.v"), "path": F.concat("best.path", F.array("frame_id"))})
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"), "timestamp_ms", "frame_id"))
    best = rows.where("value is not null").withColumn("path_no", place).where(F.col("path_no") <= paths)
    return best.select(*keys, "path_no", F.col("value").alias("score"), F.col("path").alias("frame_ids"))


def diversified(paths: DataFrame, shortlist: DataFrame, task: str, most: int = 100) -> DataFrame:
    """``place``: the best path of every shortlisted video of a task by score, then every second-best, and so on, to the
    depth at which ``most`` paths would be reached, and ``most`` at most."""
    depth = shortlist.groupBy(task).agg(F.ceil(most / F.count("*")).alias("depth"))
    deep = paths.join(depth, task).where(F.col("path_no") <= F.col("depth")).drop("depth")
    place = F.row_number().over(W.partitionBy(task).orderBy("path_no", F.desc("score"), "video_id"))
    return deep.withColumn("place", place).where(F.col("place") <= most)


def thinned(times: np.ndarray, centres: np.ndarray, reach: int, step: int) -> np.ndarray:
    """Which rows to keep around centres: within ``reach``, at least ``step`` apart from the one before; a centre always.

    From one kept row the next is found by search, not by looking at those between."""
    keep = np.zeros(len(times), bool)
    after = np.maximum(np.searchsorted(times, times + step), np.arange(len(times)) + 1)
    for c in np.flatnonzero(centres).tolist():
        at, stop = np.searchsorted(times, times[c] - reach), np.searchsorted(times, times[c] + reach, side="right")
        while at < stop:
            keep[at] = True
            at = min(after[at], c) if at < c else after[at]
    return keep


def _first_from(values: np.ndarray, start: int, stop: int, least: float) -> int:
    """The first place from ``start`` up to ``stop`` with a value of at least ``least``, else ``stop``; looks at twice as many
    values at a time as before, so a near place is found soon and a far one in few steps."""
    width = 64
    while start < stop:
        hits = np.flatnonzero(values[start : min(start + width, stop)] >= least)
        if len(hits):
            return start + int(hits[0])
        start, width = start + width, 2 * width
    return stop


def coverage_anchors(times: np.ndarray, motion: np.ndarray, marked: np.ndarray, threshold: float, widest: int, narrowest: int) -> np.ndarray:
    """Rows to keep besides the marked ones, so that the gap to the last kept row stays under a limit that shrinks from
    ``widest`` to ``narrowest`` as motion rises to ``threshold``; the row before the one that reaches it is taken.

    A row is due once the last kept row is at its time less its limit, or before.  So from each kept row the next that is due is
    searched for, up to the next marked one, and what lies between is passed over."""
    calm = np.minimum(motion / threshold, 1.0) if threshold > 0 else (motion > 0).astype(float)
    since = times - np.rint(widest - calm * (widest - narrowest))
    stops = np.append(np.flatnonzero(marked), len(times))
    anchors, last, at = np.zeros(len(times), bool), 0, 1
    while at < len(times):
        stop = int(stops[np.searchsorted(stops, at)])
        due = _first_from(since, at, min(stop + 1, len(times)), times[last])
        if due > stop or due == len(times):
            last, at = stop, stop + 1
            continue
        anchors[max(due - 1, last + 1)] = True
        last, at = (due if due == stop else max(due - 1, last + 1)), due + 1
    return anchors


def dedup_against_kept(
    times: np.ndarray, shots: np.ndarray, motion: np.ndarray, vectors: np.ndarray, protected: np.ndarray, text: np.ndarray,
    within: int, still: float, likeness: float,
) -> np.ndarray:
    """Rows that are protected or no repeats of the last kept one: of its shot, soon after, with little motion, of the same
    text regions and much alike."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    keep, last = np.ones(len(times), bool), 0
    for i in range(1, len(times)):
        near = shots[i] == shots[last] and times[i] - times[last] <= within and motion[i] <= still and text[i] == text[last]
        keep[i] = protected[i] or not near or float(unit[i] @ unit[last]) < likeness
        last = i if keep[i] else last
    return keep


def repaired(times: np.ndarray, kept: np.ndarray, widest: int) -> np.ndarray:
    """0 for rows left out, 1 for kept ones: the first, those given, and the fewest more that leave no gap over ``widest``
    between them, each the latest within reach; 2 for a given row before which the gap could not be closed."""
    out = np.zeros(len(times), np.int64)
    if not kept.any():
        return out
    reach = np.searchsorted(times, times + widest, side="right") - 1  # the last row within reach of each
    at, out[0] = 0, 1
    for target in (np.flatnonzero(kept[1:]) + 1).tolist():
        while reach[at] < target and reach[at] > at:
            at = reach[at]
            out[at] = 1
        out[target] = 1 if reach[at] >= target else 2
        at = target
    return out


def early_diversity(ranked: DataFrame, query: str, depth: int, most: int) -> DataFrame:
    """``place`` of ranked rows (query, video_id, rank): the first ``depth`` places go to the best rows that are among the
    ``most`` best of their video, the others follow in order."""
    nth = F.row_number().over(W.partitionBy(query, "video_id").orderBy("rank"))
    rows = ranked.withColumn("_first", (nth <= most).cast("int"))
    so_far = F.sum("_first").over(W.partitionBy(query).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_late", (F.col("_first") == 0) | (so_far > depth))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("_late", "rank"))).drop("_first", "_late")


def sampled(rows: DataFrame, keys: list[str], order: list[str], most: int, required: str) -> DataFrame:
    """At most ``most`` rows of each key: all of them if there are no more, else the required ones in order, then those at
    even places (halves to even), then the first of the rest."""
    own = W.partitionBy(*keys)
    rows = rows.withColumns({"_i": F.row_number().over(own.orderBy(*order)) - 1, "_n": F.count("*").over(own)})
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / float(max(1, most - 1))).cast("int"))
    choice = F.when(F.col(required), 0).when(F.array_contains(places, F.col("_i")), 1).otherwise(2)
    taken = F.row_number().over(own.orderBy(choice, "_i"))
    return rows.withColumn("_taken", taken).where(F.col("_taken") <= most).drop("_i", "_n", "_taken")


def temporal_nms(times: np.ndarray, window: int) -> np.ndarray:
    """For rows in order of rank, the number of the kept row that suppresses each within ``window``; its own if kept."""
    kept: list[int] = []
    out = np.zeros(len(times), np.int64)
    for i, t in enumerate(times.tolist()):
        by = next((k for k in kept if abs(times[k] - t) <= window), None)
        out[i] = i if by is None else by
        if by is None:
            kept.append(i)
    return out


def interval_nms(starts: np.ndarray, ends: np.ndarray, share: float) -> np.ndarray:
    """Which intervals, best first, overlap no kept one by more than ``share`` of the shorter."""
    keep = np.zeros(len(starts), bool)
    for i in range(len(starts)):
        k = np.flatnonzero(keep)
        shared = np.minimum(ends[k], ends[i]) - np.maximum(starts[k], starts[i])
        short = np.maximum(1, np.minimum(ends[k] - starts[k], ends[i] - starts[i]))
        keep[i] = not (shared > share * short).any()
    return keep


def next_fit(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Chunk numbers of sizes in order: a new chunk where the next would not fit."""
    out, total, number = np.zeros(len(sizes), np.int64), 0, 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > limit:
            total, number = 0, number + 1
        total += s
        out[i] = number
    return out


def within_budget(sizes: np.ndarray, values: list, budget: int, most: int) -> np.ndarray:
    """Rows taken in order while they fit in what is left, ``most`` at most; one that does not fit, is empty or repeats a
    value that was taken is passed over."""
    keep, left, seen = np.zeros(len(sizes), bool), budget, set()
    for i, (size, value) in enumerate(zip(sizes.tolist(), values)):
        if 0 < size <= left and value not in seen and len(seen) < most:
            keep[i], left = True, left - size
            seen.add(value)
    return keep


def interpolated(value: str, order: str, key: str) -> Column:
    """Missing values of a column filled linearly between the known ones, at the ends with the nearest."""
    w = W.partitionBy(key).orderBy(order)
    past, coming = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    a, i = F.last(value, True).over(past), F.last(at, True).over(past)
    b, j = F.first(value, True).over(coming), F.first(at, True).over(coming)
    return F.when(a.isNull(), b).when(b.isNull() | (i == j), a).otherwise(a + (b - a) * (F.col(order) - i) / (j - i))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of neighbouring rows of one key, and where in them groups begin and end.  A group that goes on
    in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    waiting: tuple | None = None

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            new |= np.diff(codes.indices.to_numpy(zero_copy_only=False)) != 0
        return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, batch.num_rows - 1)]
        held.append(batch)
        if ends[0] == ends[1] and waiting in (None, ends[0]):
            waiting = ends[1]
            continue
        table = pa.Table.from_batches(held)
        at = cut(table)
        yield table.slice(0, at[-2]), at[:-1]
        held, waiting = table.slice(at[-2]).to_batches(), ends[1]
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def fold(rows: DataFrame, key: str | list[str], order: list[str], name: str, kind: str, f: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """``rows`` with a column that ``f`` computes over each key's rows in order.

    Rows are dealt by key and sorted by Spark; a task runs over its whole partition and cuts it where the key changes.  A
    key's rows are one task's, and in its memory: keys are videos, or a task's evidence in one."""
    keys = [key] if isinstance(key, str) else list(key)
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema.fields) + f", {name} {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in groups(batches, keys):
            if table.num_rows:
                frame = table.to_pandas()
                made = [np.asarray(f(frame.iloc[p:q].reset_index(drop=True))) for p, q in zip(at[:-1].tolist(), at[1:].tolist())]
                yield from table.append_column(name, pa.array(np.concatenate(made))).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def peaks(rows: DataFrame, threshold: float) -> DataFrame:
    """``is_peak``: a value of at least ``threshold`` that is over the one before and not under the one after."""
    w = W.partitionBy("video_id").orderBy("timestamp_ms", "frame_id")
    m = F.col("motion_score")
    before, after = F.coalesce(F.lag(m).over(w), F.lit(float("-inf"))), F.coalesce(F.lead(m).over(w), F.lit(float("-inf")))
    return rows.withColumn("is_peak", (m >= threshold) & (m > before) & (m >= after))


def coalesced(windows: DataFrame, key: str) -> DataFrame:
    """Overlapping or touching windows (key, start_ms, end_ms, score) merged: start, end, best score plus 0.05 for each
    merged window up to four."""
    w = W.partitionBy(key).orderBy("start_ms", "end_ms")
    prior = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("start_ms") > prior).cast("int"), F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return windows.withColumn("island", island).groupBy(key, "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.round(F.max("score") + 0.05 * F.least(F.count("*") - 1, F.lit(4)), 6).alias("score"), F.count("*").alias("windows"),
    )
