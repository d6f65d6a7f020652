"""Exact top-k inner products by pivot-table elimination.

1. A fixed number of vectors are pivots.  Every vector's distances to all pivots are computed once and stored with it: the
   pivot table.  Vectors are dealt into cells by their nearest pivot (few vectors into few cells, of several pivots), and
   cells into blocks; a block keeps the least and the greatest of its distances to each pivot.
2. By the triangle inequality |d(q, p) - d(x, p)| is at most d(q, x) for each pivot, so the largest of them is a lower
   bound of the distance, and with the norms an upper bound of the inner product.
3. Each query is first held against a block of the cell of its own nearest pivot; its k-th score there is a floor for what follows.
4. Blocks of queries and blocks of candidates meet only if the bound between their ranges of distances reaches the lowest
   floor in the block.  Where they meet, a query's candidates are evaluated in order of their own bounds until the bound
   falls below the query's k-th best score.  The best k of all blocks are ranked together.

Scores are integers and exact.  How much the bounds save is a matter of the data: among clustered vectors most blocks never
meet, among vectors in all directions nearly all of them do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .kernels import lists

PIVOTS, BLOCK, STEP = 32, 4096, 256
SCALE = 256


def quantised(vectors: DataFrame, id_col: str, vec_col: str, *keep: str) -> DataFrame:
    """vec_id, v (components as floor(256 * x)) and the columns ``keep``; rows with null vectors or null or non-finite
    components are left out."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), x, *keep).where(x.isNotNull() & (F.size(x) > 0)).where(~bad)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double"))).alias("v"), *keep).where(
        "vec_id is not null"
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    parts = [np.asarray(c.flatten()) for c in column.chunks]
    return np.concatenate(parts).reshape(len(column), width) if parts else np.zeros((0, width))


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """PIVOTS vectors of each length, of the 64 lengths that come first; vectors of further lengths have none, so all their
    blocks meet."""
    order = W.partitionBy("dims").orderBy(F.xxhash64("vec_id"), "vec_id")
    few = vectors.withColumn("at", F.row_number().over(order)).where(F.col("at") <= PIVOTS).orderBy("dims", "at").limit(64 * PIVOTS)
    out: dict[int, list] = {}
    for r in few.toLocalIterator():
        out.setdefault(r["dims"], []).append(r["v"])
    return {d: np.array(v, np.int64) for d, v in out.items()}


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` (vec_id, v, dims) with d (distances to the pivots), near (the nearest) and n2 (the squared norm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for size in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == size))
                x = _matrix(pa.chunked_array([own.column("v")]), size).astype(float)
                p = pivots.get(size, np.zeros((0, size))).astype(float)
                n2 = (x**2).sum(1)
                # from differences: the square of a far pivot's norm would leave no digits for the rest
                d = np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in p], 1) if len(p) else np.zeros((len(x), 0))
                near = d.argmin(1) if len(p) else np.zeros(len(x), int)
                columns = [*own.columns, lists(list(d), pa.float64()), pa.array(near.astype(np.int32)), pa.array(n2)]
                yield pa.RecordBatch.from_arrays(columns, [*own.schema.names, "d", "near", "n2"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, dims int, d array<double>, near int, n2 double")


def _cell(count: int) -> Column:
    """The cell of a row of the pivot table, when so many rows are dealt out."""
    cells = min(PIVOTS, max(1, -(-count // BLOCK)))
    return F.floor(F.col("near") * cells / PIVOTS).cast("int")


def _dealt(rows: DataFrame, count: int, name: str) -> DataFrame:
    """``rows`` of the pivot table with ``name``, a block: a struct of dims, cell and a part of about BLOCK rows."""
    rows = rows.withColumn("cell", _cell(count))
    parts = rows.groupBy("dims", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), "parts").cast("int")
    return rows.join(parts, ["dims", "cell"]).select("*", F.struct("dims", "cell", part.alias("part")).alias(name)).drop("parts", "cell")


def _ranges(rows: DataFrame, block: str, *more) -> DataFrame:
    """Of each block the least and greatest distance to each pivot and the greatest squared norm."""
    low = F.array(*[F.min(F.get("d", F.lit(i))) for i in range(PIVOTS)])
    high = F.array(*[F.max(F.get("d", F.lit(i))) for i in range(PIVOTS)])
    names = [f"{x}_{block}" for x in ("low", "high", "n2")]
    return rows.groupBy(block).agg(low.alias(names[0]), high.alias(names[1]), F.max("n2").alias(names[2]), *more)


#: What rounding may take from a difference of two distances, as a share of them: a far pivot's are inexact by more than
#: the gap it shows.
LOSS = 1e-12


def _slack(a: float, b: float) -> float:
    """What rounding may take from a bound on vectors of these squared norms."""
    return 1e-6 * (a + b) + 1.0


def search(queries: pa.Table, rows: pa.Table, dims: int, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """((query, candidate, score) of the k best candidates of a block for each query, ties to the smaller id; the number
    of candidates evaluated).  ``queries`` has a floor, below which nothing counts, or null."""
    rows = rows.sort_by("vec_id")
    xid, x = rows["vec_id"].to_numpy(), _matrix(rows["v"], dims).astype(np.int64)
    qid, q = queries["vec_id"].to_numpy(), _matrix(queries["v"], dims).astype(np.int64)
    pivots = len(queries["d"][0])
    dx, dq = _matrix(rows["d"], pivots), _matrix(queries["d"], pivots)
    nx, nq = rows["n2"].to_numpy(), queries["n2"].to_numpy()
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims < 2.0**52
    xf, qf = x.astype(float), q.astype(float)
    floors, single = queries["floor"].to_pylist(), len(np.unique(xid)) == len(xid)
    slack = _slack(float(nq.max(initial=0)), float(nx.max(initial=0)))
    out: list[tuple[int, int, int]] = []
    evaluated = 0
    for i in range(len(qid)):
        gap = np.zeros(len(xid))
        for p in range(pivots):
            np.maximum(gap, np.abs(dx[:, p] - dq[i, p]) - LOSS * (dx[:, p] + dq[i, p]), out=gap)
        bound = (nq[i] + nx - gap * gap) / 2 + slack
        order = np.argsort(-bound)
        floor = floors[i]
        best: list[tuple[int, int]] = []  # (-score, id) of different ids, sorted
        for at in range(0, len(order), STEP):
            least = -best[-1][0] if len(best) == k else floor
            if least is not None and bound[order[at]] < least:
                break
            part = order[at : at + STEP]
            part = part[xid[part] != qid[i]]
            evaluated += len(part)
            scores = np.rint(xf[part] @ qf[i]).astype(np.int64) if exact else x[part] @ q[i]
            if least is not None:
                good = scores >= least
                part, scores = part[good], scores[good]
            elif single and len(part) > 8 * k:
                good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                part, scores = part[good], scores[good]
            best = sorted(best + [(-s, v) for s, v in zip(scores.tolist(), xid[part].tolist())])
            if not single:
                once: dict[int, int] = {}
                for s, v in best:
                    once.setdefault(v, s)
                best = [(s, v) for v, s in once.items()]
            best = best[:k]
        out += [(int(qid[i]), v, -s) for s, v in best]
    return out, evaluated


def _met(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of every two blocks under one key."""
    names = ["query_id", "vec_id", "score"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found, _ = search(a, b, a["dims"][0].as_py(), k) if a.num_rows and b.num_rows else ([], 0)
        return pa.Table.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")


def topk_inner_product(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` the k rows of ``vectors`` (both from
    ``quantised``) of the highest inner product, other than those of the query's own id; all, if fewer.

    Ties go to the smaller vec_id; a repeated id keeps its best score only.  Vectors of different lengths don't meet.
    Products beyond 64 bits are not defined.  An empty table gives no rows."""
    dims = F.size("v").alias("dims")
    given = common.table(vectors.select("vec_id", "v", dims), "vectors")
    pivots = _pivots(given)
    rows, questions = (common.table(pivot_table(r, pivots), "pivots") for r in (given, queries.select("vec_id", "v", dims)))
    n = rows.count()
    seen = common.table(_dealt(rows, n, "x"), "blocks")
    asked = common.table(_dealt(questions, questions.count(), "q"), "asked")
    common.drop(given, rows, questions)

    # a floor for each query: the k-th score among a block of its nearest pivot's cell; a repeated id counts once
    own = ["dims", "cell", "q"]
    left = asked.withColumns({"cell": _cell(n), "floor": F.lit(None).cast("long")})
    first = seen.where("x.part = 0").withColumn("cell", F.col("x.cell"))
    homes = common.table(left.select(*own).distinct(), "homes")
    tried = _met(left, first.join(homes, ["dims", "cell"]), own, k)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floors = tried.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("place", place)
    floors = floors.where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    asked = common.table(asked.join(common.table(floors, "floors"), "vec_id", "left"), "floored")

    # which blocks meet: the largest gap between their ranges of distances bounds the inner product from above
    a = _ranges(asked, "q", F.when(F.count("*") == F.count("floor"), F.min("floor")).alias("least"))
    b = _ranges(seen, "x")
    pairs = a.withColumn("dims", F.col("q.dims")).join(b.withColumn("dims", F.col("x.dims")), "dims")
    gaps = F.zip_with(
        F.zip_with("low_q", "high_x", lambda p, q: p - q - LOSS * (p + q)),
        F.zip_with("low_x", "high_q", lambda p, q: p - q - LOSS * (p + q)),
        lambda p, q: F.greatest(p, q, F.lit(0.0)),
    )
    gap = F.coalesce(F.array_max(gaps), F.lit(0.0))
    bound = (F.col("n2_q") + F.col("n2_x") - gap * gap) / 2 + 1e-6 * (F.col("n2_q") + F.col("n2_x")) + 1.0
    pairs = common.table(pairs.where(F.col("least").isNull() | (bound >= F.col("least"))).select("q", "x"), "meeting")

    best = _met(asked.join(pairs, "q"), seen.join(pairs, "x"), ["q", "x"], k)
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
