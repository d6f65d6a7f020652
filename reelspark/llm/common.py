"""Shared ground of the operators: tables cut from their lineage, ordered numbering, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Stands for a null id inside an operator; results give null again.
NULL_ID = -(2**63)
#: The setting of how many rows go to a Python worker at a time, Spark's default for it, and what takes its place while a
#: table is written: texts may be long, and both sides hold a batch.  Another value than the default is the user's and stays.
BATCH, DEFAULT_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
#: Rows of an id column that may be broadcast; above, the join is a shuffle.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; in local mode, where none is set, an own one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-reelspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/reelspark"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs neither repeat its work nor need the executors
    that did it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    default = spark.conf.get(BATCH) == DEFAULT_ROWS
    if default:
        spark.conf.set(BATCH, BATCH_ROWS)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if default:
            spark.conf.set(BATCH, DEFAULT_ROWS)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    for made in _open:
        made.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Remove what ``table`` has written, once nothing is going to read it again."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: The lists that tables are noted in as they are written.
_open: list[list[DataFrame]] = []


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, as a table; the tables written on the way to it are removed."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        rows = make()
        on_the_way = list(made)
        out = table(rows, name)
    finally:
        _open.remove(made)
    drop(*on_the_way)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names, the id without nulls."""
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"), docs[text_col].cast("string").alias("text")
    )


def shown(id_column: Column) -> Column:
    """An id as given: null again where it was null."""
    return F.when(id_column != NULL_ID, id_column)


def pick(rows: DataFrame, wanted: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join the large ``rows`` with the slim ``wanted`` (a written table).  Up to BROADCAST_ROWS ids, with columns of at
    most 8 bytes, are broadcast so that other rows' texts are not shuffled; more are a shuffle.  Columns of other types
    are joined after."""
    fixed = {"bigint", "int", "double", "boolean"}
    ids = wanted.select(on, *[c for c, kind in wanted.dtypes if kind in fixed and c != on]) if how == "inner" else wanted.select(on)
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if how != "inner":
        return rows.join(F.broadcast(ids) if few else ids, on, how)
    if few and len(ids.columns) == len(wanted.columns):
        return rows.join(F.broadcast(ids), on)
    return (rows.join(F.broadcast(ids.select(on)), on, "left_semi") if few else rows).join(wanted, on)


def numbered(df: DataFrame, keys: list[Column], name: str, per: str | None = None) -> DataFrame:
    """Add ``position``: each row's place (from 0) in the order of ``keys``, within ``per`` if given.

    Rows are dealt into ranges of the whole order, so that a hot group spans many tasks; each range numbers its own
    rows, and the ranges' counts (one row for each range and group) give the offsets."""
    parts = df.repartitionByRange(*([F.col(per).asc_nulls_last()] if per else []), *keys)
    order = ([F.col(per).asc_nulls_last()] if per else []) + keys
    ranged = table(parts.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    group = [F.col(per)] if per else []
    counts = ranged.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_part").alias("_p"),
        *([F.col(per).alias("_g")] if per else []),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        "_first",
    )
    on = F.col("_part") == F.col("_p")
    if per:
        on = on & F.col(per).eqNullSafe(F.col("_g"))
    return ranged.join(offsets, on).withColumn("position", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_at", "_part", "_p", "_g", "_before", "_first"
    )


def _marked(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``edges`` as a table, and their number and a digest of them, taken while they are written."""
    seen = Observation()
    h = F.xxhash64("u", "v")
    out = table(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y")), name)
    return out, tuple(seen.get.values())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v): rows (node, root), root the smallest node reachable.

    Alternates large and small stars (Kiveris et al., 2014) until nothing changes; a round is one job, whose group minima
    are combined before the shuffle, and is written as a table."""
    e, mark = _marked(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before = e
        e, now = _marked(small.where("u <> v").distinct(), "stars")
        drop(before)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
