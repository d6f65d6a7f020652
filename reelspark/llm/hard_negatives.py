"""Hard negatives by anchor-clustered shared lists (after MAXIMUS, Abuzaid et al., 2019).

1. Anchors are dealt into clusters by the nearest of a few directions, at most CLUSTER anchors each.  A cluster has a
   centre and the widest angle w between it and a member.
2. Rows are dealt into blocks by nearest direction and a part of about BLOCK rows.  For one cluster a block is a page of
   the shared list: its rows are sorted once by |x| * cos(max(0, angle(x, centre) - w)), which times |q| is above the inner
   product of x with every member q.
3. Every member walks that list.  It is certain to be done once the bound falls below what could still enter its answer.
4. Pages as a whole have such a bound, too, so a page whose best row can't reach any member's answer is never joined.

First the positives are walked for, among rows of the same label (dealt by label, so that other labels are never met),
then the negatives among rows of other labels: they are wanted between ``low`` and ``high`` percent of each positive's
score, so a list ends at ``low`` percent of the least positive at the latest.

Scores are integers and exact.  What the bounds save is a matter of the data: among clustered vectors most pages never
meet a cluster, among vectors in all directions nearly all do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .kernels import lists

#: Directions that rows are dealt by; anchors of a cluster, rows of a page, rows of a page that are scored at a time.
DIRECTIONS, CLUSTER, BLOCK, STEP = 32, 256, 4096, 512
#: Groups that labels are dealt into where only rows of one label meet.
LABELS = 32


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _directions(rows: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors that rows are dealt by: for each length (the 64 that come first) DIRECTIONS rows, by hashed id.  They
    have no part in what is found, only in how much is walked for it."""
    order = W.partitionBy("dims").orderBy(F.xxhash64("vec_id"), "vec_id")
    few = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= DIRECTIONS).orderBy("dims", "at").limit(64 * DIRECTIONS)
    out: dict[int, list] = {}
    for r in few.toLocalIterator():
        out.setdefault(r["dims"], []).append(r["v"])
    return {d: _unit(np.array(v, float)) for d, v in out.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x**2).sum(-1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _directed(rows: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with near, the direction that is nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, near = batch.column("dims").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for size in np.unique(dims).tolist():
                own = dims == size
                if size in directions:
                    near[own] = (_matrix(batch.column("v").filter(pa.array(own))).astype(float) @ directions[size].T).argmax(1)
            yield batch.append_column("near", pa.array(near))

    return rows.mapInArrow(run, "vec_id long, label long, v array<long>, dims int, near int")


def _dealt(rows: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """``rows`` with ``name``, a struct of dims, ``by`` and a part: groups of about ``size`` rows.  Neighbouring directions
    share a cell where there are few rows."""
    groups = rows.groupBy("dims", *by[:-1]).agg(F.greatest(F.lit(1), F.least(F.lit(DIRECTIONS), F.ceil(F.count("*") / size))).alias("cells"))
    rows = rows.join(groups, ["dims", *by[:-1]])
    rows = rows.withColumn("cell", F.floor(F.col("near") * F.col("cells") / DIRECTIONS).cast("int")).drop("cells")
    key = ["dims", *by[:-1], "cell"]
    parts = rows.groupBy(*key).agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), "parts").cast("int")
    return rows.join(parts, key).withColumn(name, F.struct(*key, part.alias("part"))).drop("parts", "cell")


def _described(rows: DataFrame, name: str, most: bool) -> DataFrame:
    """For each group ``name``: its centre, the cosine of the widest angle to it, the greatest norm, and with ``most`` the
    least of the column ``least`` (null if one is missing)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        x = _matrix(group["v"]).astype(float)
        unit, norm = _unit(x), np.sqrt((x**2).sum(1))
        centre = _unit(unit.sum(0))
        close = float((unit @ centre).min()) if (norm > 0).all() else -1.0
        least = group["least"] if most else None
        low = None if least is None or least.null_count else min(least.to_pylist())
        first = {c: group[c][:1] for c in (name,)}
        return pa.table({**first, "centre": lists([centre], pa.float64()), "close": [close], "norm": [float(norm.max())], "low": pa.array([low], pa.float64())})

    shape = f"{name} {dict(rows.dtypes)[name]}, centre array<double>, close double, norm double, low double"
    return rows.select(name, "v", *(["least"] if most else [])).groupBy(name).applyInArrow(run, shape)


def _slack(norms: Column | np.ndarray | float) -> Column | np.ndarray | float:
    """What rounding may take from a bound on vectors of this product of norms."""
    return 1e-6 * norms + 1.0


def _pages(clusters: DataFrame, blocks: DataFrame, same: list[str]) -> DataFrame:
    """(q, x) of the clusters and blocks that must meet: those of like ``same``, where the angle between the centres less
    both widest angles leaves a bound of at least what some member lacks."""
    a = clusters.select("q", "close", "norm", "low", F.col("centre").alias("c"), *[F.col(f"q.{s}").alias(s) for s in same])
    b = blocks.select("x", F.col("close").alias("close_x"), F.col("norm").alias("norm_x"), F.col("centre").alias("c_x"), *[F.col(f"x.{s}").alias(s) for s in same])
    pairs = a.join(b, same)
    dot = F.aggregate(F.zip_with("c", "c_x", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    gap = F.greatest(F.lit(0.0), angle(dot) - angle(F.col("close")) - angle(F.col("close_x")))
    norms = F.col("norm") * F.col("norm_x")
    # a negative cosine bounds nothing from above that 0 doesn't, as shorter vectors have products nearer 0
    bound = norms * F.greatest(F.lit(0.0), F.cos(gap)) + _slack(norms)
    return pairs.where(F.col("low").isNull() | (bound >= F.col("low"))).select("q", "x")


class List:
    """A page of a cluster's shared list: rows in the order of their bounds, and the bounds for a member of norm 1."""

    def __init__(self, members: pa.Table, rows: pa.Table):
        self.q, x = _matrix(members["v"]).astype(np.int64), _matrix(rows["v"]).astype(np.int64)
        unit = _unit(self.q.astype(float))
        centre = _unit(unit.sum(0))
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        wide = np.arccos(np.clip((unit @ centre).min(), -1, 1)) if np.any(self.q, axis=1).all() else np.pi
        angle = np.arccos(np.clip(_unit(x.astype(float)) @ centre, -1, 1))
        bound = norm * np.cos(np.clip(angle - wide, 0, np.pi))
        order = np.argsort(-bound, kind="stable")
        self.bound, self.x, self.norm = bound[order], x[order], np.maximum.accumulate(norm[order][::-1])[::-1]
        self.ids, self.labels = rows["vec_id"].to_numpy()[order], rows["label"].to_numpy()[order]
        self.norms = np.sqrt((self.q.astype(float) ** 2).sum(1))
        most = float(np.abs(self.q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
        self.exact = most < 2.0**52
        if self.exact:
            self.x, self.q = self.x.astype(float), self.q.astype(float)
        self.evaluated = 0

    def walk(self, i: int, least: Callable[[], float], take: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
        """Hand ``take`` the (ids, labels, scores) of the list, piece by piece, until no row to come can have a score of
        ``least()``."""
        bound = self.norms[i] * self.bound + _slack(self.norms[i] * self.norm)
        for at in range(0, len(bound), STEP):
            if bound[at] < least():
                break
            scores = self.x[at : at + STEP] @ self.q[i]
            self.evaluated += len(scores)
            take(self.ids[at : at + STEP], self.labels[at : at + STEP], scores.astype(np.int64))


def _first(kept: list[tuple[int, int]], ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k (-score, id) of those kept and those that came."""
    if len(kept) == k:
        good = scores >= -kept[-1][0]
        ids, scores = ids[good], scores[good]
    elif len(scores) > 4 * k:
        good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[good], scores[good]
    return sorted(kept + list(zip((-scores).tolist(), ids.tolist())))[:k]


def _positives(asked: DataFrame, seen: DataFrame, keys: list[str], k: int) -> DataFrame:
    """anchor_id, vec_id, score: for each anchor the first k rows of its label in each page that it meets."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if a.num_rows and b.num_rows:
            page = List(a, b)
            for i, (anchor, label, low) in enumerate(zip(a["vec_id"].to_pylist(), a["label"].to_pylist(), a["least"].to_pylist())):
                kept: list[tuple[int, int]] = []

                def take(ids, labels, scores):
                    nonlocal kept
                    good = (labels == label) & (ids != anchor)
                    kept = _first(kept, ids[good], scores[good], k)

                page.walk(i, lambda: max(-kept[-1][0] if len(kept) == k else -np.inf, -np.inf if low is None else low), take)
                out += [(anchor, v, -s) for s, v in kept]
        return pa.Table.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], ["anchor_id", "vec_id", "score"])

    shape = "anchor_id long, vec_id long, score long"
    return asked.select(*keys, "vec_id", "label", "v", "least").groupBy(*keys).cogroup(seen.groupBy(*keys)).applyInArrow(run, shape)


def _negatives(asked: DataFrame, seen: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, negative_id, negative_score: for each anchor and positive the first k rows
    of another label and a score within the bounds, in each page that the anchor meets."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if a.num_rows and b.num_rows:
            page = List(a, b)
            for i, (anchor, label, positives) in enumerate(zip(a["vec_id"].to_pylist(), a["label"].to_pylist(), a["positives"].to_pylist())):
                # least and most are score limits in whole numbers
                limits = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
                kept: list[list[tuple[int, int]]] = [[] for _ in limits]

                def take(ids, labels, scores):
                    good = (labels != label) & (scores >= min(x for x, _ in limits)) & (ids != anchor)
                    ids, scores = ids[good], scores[good]
                    for j, (least, most) in enumerate(limits):
                        within = (scores >= least) & (scores <= most)
                        kept[j] = _first(kept[j], ids[within], scores[within], k)

                page.walk(i, lambda: min(-n[-1][0] if len(n) == k else least for n, (least, _) in zip(kept, limits)), take)
                out += [(anchor, p["id"], p["score"], v, -s) for p, n in zip(positives, kept) for s, v in n]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.Table.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(5)], names)

    shape = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    return asked.select("q", "x", "vec_id", "label", "v", "positives").groupBy("q", "x").cogroup(seen.groupBy("q", "x")).applyInArrow(run, shape)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor its first
    ``positives`` other rows of the same label, and for each of them the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.  Higher inner products are first, ties by the
    smaller id; all, if there are fewer.

    ``vectors`` has vec_id, label and v (as from ``topk_search.quantised``), ``anchors`` the vec_id of some of them.  Rows
    with a null in one of the three take no part.  Where an id repeats, its row of the smallest label and vector counts.
    Vectors of different lengths don't meet.  A positive with a score below 0 has no negatives, as no number is within
    its bounds.  Products beyond 64 bits are not defined.  An empty table gives no rows."""
    if not 0 <= low <= high:
        raise ValueError("low must be from 0 to high")
    rows = vectors.where("vec_id is not null and label is not null and v is not null and size(v) > 0")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "v")).alias("r"))
    given = common.table(rows.select("vec_id", "r.label", "r.v", F.size("r.v").alias("dims")), "vectors")
    table = common.table(_directed(given, _directions(given)), "directed")
    chosen = common.table(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct(), "anchors")
    members = common.table(common.pick(table, chosen, "vec_id", "left_semi"), "members")
    group = F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int").alias("labels")

    # positives: clusters and pages of a group of labels; a page near the cluster gives each member a floor
    asked = common.table(_dealt(members.select("*", group), ["labels", "near"], CLUSTER, "q").withColumn("least", F.lit(None).cast("double")), "asked")
    seen = common.table(_dealt(table.select("*", group), ["labels", "near"], BLOCK, "x").select("vec_id", "label", "v", "x"), "pages")
    same = ["dims", "labels"]
    pages = common.table(_described(seen, "x", False), "described")
    clusters = common.table(_described(asked, "q", True), "clusters")
    near = common.table(_nearest(clusters, pages, same), "near")
    tried = _positives(asked.join(near, "q"), seen.join(near, "x"), ["q", "x"], positives)
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    tried = common.table(tried.withColumn("place", place).where(F.col("place") <= positives), "tried")
    floors = tried.where(F.col("place") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    asked = common.table(asked.drop("least").join(floors, "vec_id", "left"), "floored")
    meeting = _pages(_described(asked, "q", True), pages, same).join(near.withColumn("done", F.lit(True)), ["q", "x"], "left_anti")
    meeting = common.table(meeting, "meeting")
    more = _positives(asked.join(meeting, "q"), seen.join(meeting, "x"), ["q", "x"], positives)
    best = tried.drop("place").unionByName(more).withColumn("place", place).where(F.col("place") <= positives)
    best = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", F.col("vec_id").alias("id")))).alias("positives"))
    best = best.withColumn("positives", F.filter("positives", lambda p: p["score"] >= 0)).where(F.size("positives") > 0)

    # negatives: clusters and pages of all labels, down to the low bound of the least positive
    asked = members.join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    asked = asked.withColumn("least", F.col("positives")[0]["score"] * F.lit(low / 100))
    asked = common.table(_dealt(asked, ["near"], CLUSTER, "q"), "asked")
    seen = common.table(_dealt(table, ["near"], BLOCK, "x").select("vec_id", "label", "v", "x"), "pages")
    meeting = common.table(_pages(_described(asked, "q", True), _described(seen, "x", False), ["dims"]), "meeting")
    found = _negatives(asked.join(meeting, "q"), seen.join(meeting, "x"), negatives, low, high)
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _nearest(clusters: DataFrame, pages: DataFrame, same: list[str]) -> DataFrame:
    """(q, x): for each cluster one page, of the group of its own labels, that is likely to hold its best rows: the one
    whose centre is nearest."""
    a = clusters.select("q", F.col("centre").alias("c"), *[F.col(f"q.{s}").alias(s) for s in same])
    b = pages.select("x", F.col("centre").alias("c_x"), *[F.col(f"x.{s}").alias(s) for s in same])
    dot = F.aggregate(F.zip_with("c", "c_x", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return a.join(b, same).groupBy("q").agg(F.max_by("x", F.struct(dot, F.col("x"))).alias("x"))
