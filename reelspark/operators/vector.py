"""Exact vector search: inner products, top-k joins, filtered and pairwise scoring, index checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from . import sequences


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, by built-in functions."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: str) -> Column:
    """A vector divided by its length; null where that is 0."""
    return F.when(norm(a) > 0, F.transform(F.col(a), lambda x: x.cast("double") / norm(a)))


#: Queries that one task scores at a time, the most that are shipped with the plan, and corpus rows of a block.
BLOCK, SHIPPED, ROWS = 256, 4096, 4096
#: Corpus rows of one product: with BLOCK queries the scores are 2 MB, whatever the size of the tables.
STEP = 1024
#: Rows that a search may hold besides those among the best.
HELD = 65536


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(float).reshape(len(flat), -1)


class _Best:
    """The k best rows so far of each of some queries (ids, matrix), ties to the smaller frame_id.

    Scores that beat a query's k-th wait beside the best of its block of queries, until there are some for each; only then the
    k best are sorted out.  That comes whenever the rows seen have grown by about a half, and not at every step.  Rows
    that are in no list any more go when they are as many as those that are."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, kept: list[str], k: int, digits: int):
        self.ids, self.matrix, self.kept, self.k, self.digits = ids, matrix, kept, k, digits
        self.scores = np.full((len(ids), k), -np.inf)
        self.frames = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.at = np.full((len(ids), k), -1, np.int32)
        self.rows: pa.Table | None = None
        self.most = HELD
        self.waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.counts = np.zeros(len(ids), np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        for i in range(0, batch.num_rows, STEP):
            self._add(batch.slice(i, STEP))

    def _add(self, batch: pa.RecordBatch) -> None:
        vectors, frames = _matrix(batch.column("embedding")).T, batch.column("frame_id").to_numpy(zero_copy_only=False)
        held, taken, wait = 0 if self.rows is None else self.rows.num_rows, False, max(self.k, 64) // 2
        for i in range(0, len(self.ids), BLOCK):
            # only what may reach a query's k-th is rounded
            own, least = self.matrix[i : i + BLOCK] @ vectors, self.scores[i : i + BLOCK, -1:]
            found = np.flatnonzero(own >= least - 10.0**-self.digits)
            score, (q, x) = np.round(own.reshape(1, -1)[:, found], self.digits)[0], np.divmod(found, own.shape[1])
            kth = least[q, 0]
            better = (score > kth) | ((score == kth) & (frames[x] < self.frames[i + q, -1]))
            if not better.any():
                continue
            taken, q, x, score = True, q[better], x[better], score[better]
            self.waiting.setdefault(i, []).append((q.astype(np.int32), score, frames[x], (held + x).astype(np.int32)))
            counts = self.counts[i : i + BLOCK]
            counts += np.bincount(q, minlength=len(counts))
            if counts.max() > 4 * wait or counts.sum() > wait * len(counts):
                self._choose(i)
        if taken:  # a copy, as a slice would keep the vectors of its batch
            rows = pa.Table.from_batches([batch.select(self.kept)]).take(pa.array(np.arange(batch.num_rows)))
            self.rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
            if self.rows.num_rows > self.most:
                self._drop()

    def _choose(self, i: int) -> None:
        """The k best of a block's queries, of their best so far and those that wait."""
        q, score, frame, at = (np.concatenate(x) for x in zip(*self.waiting.pop(i)))
        counts = self.counts[i : i + BLOCK].copy()
        self.counts[i : i + BLOCK] = 0
        some, order = np.flatnonzero(counts), np.argsort(q, kind="stable")
        q = q[order]
        line = (np.cumsum(counts > 0) - 1)[q]
        place = self.k + np.arange(len(q)) - (np.cumsum(counts) - counts)[q]
        both = []
        for mine, new, none in ((self.scores, score, -np.inf), (self.frames, frame, np.iinfo(np.int64).max), (self.at, at, -1)):
            seen = np.full((len(some), self.k + int(counts.max())), none, mine.dtype)
            seen[:, : self.k], seen[line, place] = mine[i + some], new[order]
            both.append(seen)
        scores, ids, _ = both
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        for mine, seen in zip((self.scores, self.frames, self.at), both):
            mine[i + some] = np.take_along_axis(seen, order, 1)

    def _drop(self) -> None:
        """Nothing waits, and only rows in some list are held."""
        for i in list(self.waiting):
            self._choose(i)
        used = np.zeros(self.rows.num_rows, bool)
        used[self.at[self.at >= 0]] = True
        moved = (np.cumsum(used) - 1).astype(np.int32)
        for i in range(0, len(self.ids), BLOCK):
            at = self.at[i : i + BLOCK]
            at[at >= 0] = moved[at[at >= 0]]
        self.rows = self.rows.filter(pa.array(used)).combine_chunks()
        self.most = 2 * self.rows.num_rows + HELD

    def found(self, shape: pa.Schema) -> Iterator[pa.RecordBatch]:
        """query_id, the kept columns and score (and the rank, if ``shape`` has it), a bounded number of rows at a time."""
        width = max(1, 65536 // self.k)
        if self.rows is not None:
            self._drop()
        for i in range(0, len(self.ids) if self.rows is not None else 0, width):
            at, there = self.at[i : i + width], self.at[i : i + width] >= 0
            rows = self.rows.take(pa.array(at[there]))
            ids = pa.array(np.repeat(self.ids[i : i + width], there.sum(1)))
            rank = [pa.array(np.cumsum(there, 1)[there])] if "rank" in shape.names else []
            yield from pa.Table.from_arrays([ids, *rows.columns, pa.array(self.scores[i : i + width][there]), *rank], names=shape.names).cast(shape).to_batches()


def _block_join(queries: DataFrame, corpus: DataFrame, kept: list[str], shape: StructType, k: int, digits: int) -> DataFrame:
    """The k best of each block of queries in each part of the corpus.  A pair of these is one run of rows of a partition,
    first its queries, then the part of the corpus, which passes by in Arrow batches: a task holds one block of queries and
    their best.  Blocks and parts are as many as keep some tasks busy: a block more is a copy of the corpus more, a part
    more is k rows a query more (a vector weighs about as much as six of them), and both together are to be least.  Where
    the corpus is one part, and no two queries have one id, the k best of a query come whole and in order, with ``rank``."""
    spark = queries.sparkSession
    number, ids = queries.agg(F.count("*"), F.count_distinct("query_id")).first()
    rows = corpus.count()
    tasks = 2 * spark.sparkContext.defaultParallelism
    qb = max(1, -(-number // SHIPPED), min(tasks, round(math.sqrt(tasks * number * k / (6 * max(rows, 1))))))
    xb = max(1, min(-(-rows // ROWS), -(-tasks // qb)))
    if xb == 1 and ids == number:
        shape = StructType([*shape.fields, StructField("rank", IntegerType())])
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    left = queries.select(block("query_id", qb).alias("_q"), every(xb).alias("_x"), F.col("query_id"), F.col("query"), *[none(c, corpus) for c in (*kept, "embedding")])
    right = corpus.select(every(qb).alias("_q"), block("frame_id", xb).alias("_x"), none("query_id", queries), none("query", queries), *kept, "embedding")
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, best = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = batch.column("_q").to_numpy().astype(np.int64) * xb + batch.column("_x").to_numpy()
            asks = batch.column("query_id").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((pairs[1:] != pairs[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if pairs[a] != key:
                    if best is not None:
                        yield from best.found(arrow)
                    key, ids, vectors, best = pairs[a], [], [], None
                if asks[a]:
                    ids.append(part.column("query_id").to_numpy())
                    vectors.append(_matrix(part.column("query")))
                elif ids:
                    if best is None:
                        best = _Best(np.concatenate(ids), np.concatenate(vectors), kept, k, digits)
                    best.add(part)
        if best is not None:
            yield from best.found(arrow)

    both = left.unionByName(right).withColumn("_side", F.col("query_id").isNull())
    return both.repartitionById(qb * xb, F.col("_q") * xb + F.col("_x")).sortWithinPartitions("_q", "_x", "_side").drop("_side").mapInArrow(run, shape)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """For each row of ``queries`` (query_id, query) the k rows of ``corpus`` (with frame_id and embedding) of the highest
    inner product, ties by frame_id: the columns of ``corpus`` but the vector, query_id, score, rank.

    Up to SHIPPED queries go to every task as one matrix, and the corpus passes by in steps of STEP rows; a task keeps the k
    best so far of each query, and only those leave it.  More queries are rows of blocks that meet parts of the corpus; the
    driver sees no more than SHIPPED and one."""
    kept = [c for c in corpus.columns if c != "embedding"]
    shape = StructType([StructField("query_id", LongType()), *[corpus.schema[c] for c in kept], StructField("score", DoubleType())])
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "query")
    given = queries.limit(SHIPPED + 1).toPandas()
    if len(given) > SHIPPED:
        local = _block_join(queries, corpus, kept, shape, k, digits)
        if "rank" in local.columns:
            return local
    else:
        given = given.sort_values("query_id", kind="stable")
        ids = given["query_id"].to_numpy()
        matrix = np.stack(given["query"].to_list()).astype(float) if len(given) else np.zeros((0, 1))
        arrow = to_arrow_schema(shape)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(ids, matrix, kept, k, digits)
            for batch in batches:
                if batch.num_rows and len(ids):
                    best.add(batch)
            yield from best.found(arrow)

        local = corpus.mapInArrow(run, shape)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "frame_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_expression(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The same by built-in functions alone, for a handful of queries (their count is checked before the broadcast)."""
    if queries.limit(257).count() > 256:
        return knn_join(queries, corpus, k, digits)
    pairs = corpus.join(F.broadcast(queries.select("query_id", "query")), F.lit(True))
    scored = pairs.withColumn("score", F.round(dot("query", "embedding"), digits)).drop("query", "embedding")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "frame_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Queries that meet one block of a video's frames in one group.
ASKED = 256


def scored_within(queries: DataFrame, corpus: DataFrame, videos: DataFrame, digits: int = 6, most: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """``score`` of every row of ``queries`` (query_id, query, ...) with every frame of the videos given for it in
    ``videos`` (query_id, video_id, distinct).

    The queries of a video meet its frames in blocks of ASKED by ROWS, each one matrix product; a video that is long, or
    asked by many, is several blocks.  A task's blocks are one run of its rows, so many small ones cost little.  Where only
    the ``most`` best frames of a query and video are wanted (``ties`` by columns of ``corpus``), no block gives more."""
    kept, named = [c for c in corpus.columns if c != "embedding"], [c for c in queries.columns if c not in ("query_id", "query")]
    shape = StructType([StructField("query_id", LongType()), *[corpus.schema[c] for c in kept], StructField("score", DoubleType()), *[queries.schema[c] for c in named]])
    arrow, own_names = to_arrow_schema(shape), [f"_of_{c}" for c in named]
    wanted = videos.select("query_id", "video_id")
    part = lambda key, size: F.ceil(F.count("*") / size).cast("int").alias(f"{key}_parts")
    parts = wanted.groupBy("video_id").agg(part("q", ASKED)).join(corpus.groupBy("video_id").agg(part("x", ROWS)), "video_id")
    block = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = wanted.join(parts, "video_id").join(queries.withColumnsRenamed({c: f"_of_{c}" for c in named}), "query_id")
    left = left.withColumn("_q", block("query_id", "q_parts")).withColumn("_x", every("x_parts"))
    right = corpus.join(parts, "video_id").withColumn("_x", block("frame_id", "x_parts")).withColumn("_q", every("q_parts")).drop("q_parts", "x_parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in sequences.groups(batches, keys):
            if not table.num_rows:
                continue
            asks = table["query_id"].is_valid().to_numpy()
            ask, row = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
            if not ask.num_rows or not row.num_rows:
                continue
            a, b = _matrix(ask["query"]), _matrix(row["embedding"]).T
            to = np.concatenate([[0], np.cumsum(asks)])[at]
            of = np.asarray(at) - to
            q, x, scores, n = [], [], [], 0
            for i in range(len(to) - 1):
                own = a[to[i] : to[i + 1]] @ b[:, of[i] : of[i + 1]]
                if own.size:
                    own, rows = np.round(own, digits), np.broadcast_to(np.arange(of[i], of[i + 1]), own.shape)
                    if most and own.shape[1] > most:
                        order = np.argsort(-own, axis=1, kind="stable")[:, :most]
                        own, rows = np.take_along_axis(own, order, 1), np.take_along_axis(rows, order, 1)
                    q.append(np.repeat(np.arange(to[i], to[i + 1]), own.shape[1]))
                    x.append(rows.ravel())
                    scores.append(own.ravel())
                    n += own.size
                if n and (n >= HELD or i == len(to) - 2):
                    which, rows = pa.array(np.concatenate(q)), row.select(kept).take(pa.array(np.concatenate(x)))
                    columns = [ask["query_id"].take(which), *rows.columns, pa.array(np.concatenate(scores)), *ask.select(own_names).take(which).columns]
                    yield from pa.Table.from_arrays(columns, names=arrow.names).cast(arrow).to_batches()
                    q, x, scores, n = [], [], [], 0

    keys = ["video_id", "_q", "_x"]
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    left = left.select(*keys, F.col("query_id").cast("long").alias("query_id"), "query", *own_names, *[none(c, corpus) for c in (*kept, "embedding") if c != "video_id"])
    right = right.select(*keys, F.lit(None).cast("long").alias("query_id"), none("query", queries), *[none(c, queries).alias(f"_of_{c}") for c in named], *[c for c in (*kept, "embedding") if c != "video_id"])
    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, F.col("query_id").isNull(), *ties)
    return both.mapInArrow(run, shape)


def index_problems(index: DataFrame) -> DataFrame:
    """One row of violation counts of an index mapping (frame_id, embedding_index, embedding)."""
    size = F.size("embedding")
    return index.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.countDistinct("frame_id")).alias("repeated_ids"),
        (F.count("*") - F.countDistinct("embedding_index")).alias("repeated_positions"),
        F.coalesce(F.sum((F.col("embedding_index") < 0).cast("long")), F.lit(0)).alias("negative_positions"),
        (F.coalesce(F.max("embedding_index") + 1, F.lit(0)) - F.count("*")).alias("position_gap"),
        F.countDistinct(size).alias("dimensions"),
        F.coalesce(F.sum((F.abs(norm("embedding") - 1) > 1e-3 + 1e-4).cast("long")), F.lit(0)).alias("not_unit"),
    )


def reduced(groups: DataFrame, part: str, digits: float = 1e-4) -> DataFrame:
    """(part, frame_id, position, embedding) of groups that were built apart, one after another in the order of ``part``.

    ``groups`` has part, embedding_index, frame_id, embedding.  A group whose indexes aren't 0 to n-1, a frame that is there
    twice, vectors of different lengths, or that aren't finite and of length 1, are errors."""
    sizes = groups.groupBy(part).agg(
        F.count("*").alias("n"),
        (F.min("embedding_index") == 0) & (F.max("embedding_index") == F.count("*") - 1) & (F.count_distinct("embedding_index") == F.count("*")),
        F.min(F.size("embedding")),
        F.max(F.size("embedding")),
        F.coalesce(F.max(F.when(F.abs(norm("embedding") - 1) <= digits + 1e-5, 0).otherwise(1)), F.lit(0)),
    ).toDF(part, "n", "whole", "least", "most", "off").orderBy(part).collect()  # a row for each group
    wrong = [r[part] for r in sizes if not r.whole]
    if wrong:
        raise ValueError(f"the indexes of {wrong} are not 0 to n-1")
    if len({x for r in sizes for x in (r.least, r.most)}) > 1 or any(r.off for r in sizes):
        raise ValueError("the vectors are not all finite, of one dimension and of length 1")
    if not groups.groupBy("frame_id").count().where("count > 1").isEmpty():
        raise ValueError("a frame is there twice")
    before, starts = 0, []
    for r in sizes:
        starts.append((r[part], before))
        before += r.n
    schema = StructType([groups.schema[part], StructField("_before", LongType())])
    offsets = groups.sparkSession.createDataFrame(starts, schema)
    return groups.join(F.broadcast(offsets), part).select(part, "frame_id", (F.col("_before") + F.col("embedding_index")).alias("position"), "embedding")
