"""Vector bundles: vectors in the order of their videos, and a posting for each video that says where its vectors are.

A search among some videos asks the postings for their files and reads no other; within a file Parquet's statistics pass
over row groups of other videos.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector
from . import bundles, shared

#: Rows of a file, and of a row group, of a bundle's vectors.
FILE_ROWS, GROUP_BYTES = 65_536, 1 << 20


def _postings(vectors: DataFrame) -> DataFrame:
    """video_id, first (the position of its first vector), length, files (those that hold it)."""
    rows = vectors.select("video_id", "position", F.col("_metadata.file_name").alias("file"))
    return rows.groupBy("video_id").agg(F.min("position").alias("first"), F.count("*").alias("length"), F.sort_array(F.collect_set("file")).alias("files"))


def save(vectors: DataFrame, root: str, version: str, model: str, file_rows: int = FILE_ROWS) -> str:
    """Publishes ``vectors`` (frame_id, video_id, timestamp_ms, embedding of unit length) with positions in the order of
    video, time and frame, and postings, under a manifest with their digests, the dimension and the model."""
    spark = vectors.sparkSession
    rows = vectors.select("frame_id", "video_id", "timestamp_ms", "embedding")
    size = rows.select(F.size("embedding").alias("n")).first()
    order = [F.col("video_id"), F.col("timestamp_ms"), F.col("frame_id")]
    placed = shared.numbered(rows, order)
    files = max(1, -(-placed.count() // file_rows))
    placed = placed.repartitionByRange(files, "position").sortWithinPartitions("position")
    before = spark.conf.get("parquet.block.size", None)
    try:
        spark.conf.set("parquet.block.size", str(GROUP_BYTES))
        return bundles.publish({"vectors": placed, "postings": lambda done: _postings(done["vectors"])}, root, version, {"dimension": size[0] if size else 0, "model": model})
    finally:
        spark.conf.unset("parquet.block.size") if before is None else spark.conf.set("parquet.block.size", before)


@dataclass(frozen=True)
class Bundle:
    """A bundle that was verified: where its vectors are, its postings, its dimension and model."""

    path: str
    postings: DataFrame
    vectors: DataFrame
    dimension: int
    model: str

    def rows(self, videos: list | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """The vectors of some videos (none given: all) with start <= time <= end, from the files that the postings name."""
        rows = self.vectors
        if videos is not None:
            asked = self.postings.where(F.col("video_id").isin(videos)).select(F.explode("files").alias("f")).distinct()
            files = [f"{self.path}/{r.f}" for r in asked.orderBy("f").collect()]  # names of files, not of rows
            spark = self.vectors.sparkSession
            rows = spark.read.schema(rows.schema).parquet(*files) if files else rows.limit(0)
            rows = rows.where(F.col("video_id").isin(videos))
        rows = rows if start is None else rows.where(F.col("timestamp_ms") >= start)
        return rows if end is None else rows.where(F.col("timestamp_ms") <= end)

    def search(self, queries: DataFrame, k: int, videos: list | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """As ``vector.knn_join`` with the vectors of ``rows``."""
        return vector.knn_join(queries, self.rows(videos, start, end).select("frame_id", "embedding"), k)


def load(spark: SparkSession, root: str, version: str | None = None) -> Bundle:
    """A bundle whose tables agree with the manifest and with one another: positions are 0 to n-1, frames distinct, vectors
    finite, of unit length and the manifest's dimension; postings follow one another without gap, and each has the
    positions, the number and the files of its video's vectors."""
    version, told = bundles.manifest(spark, root, version)
    if missing := {"vectors", "postings"} - set(told["tables"]):
        raise ValueError(f"the bundle has no {', '.join(sorted(missing))}")
    tables = bundles.load(spark, root, version)
    vectors, postings = tables["vectors"], tables["postings"]
    problems = vector.index_problems(vectors.withColumnRenamed("position", "embedding_index")).first().asDict()
    rows = problems.pop("rows")
    if problems.pop("dimensions") > 1 or any(problems.values()):
        raise ValueError(f"the vectors are no index: {problems}")
    found = _postings(vectors).join(postings.select("video_id", F.col("first").alias("f"), F.col("length").alias("n"), F.col("files").alias("where")), "video_id", "full")
    same = F.col("first").eqNullSafe(F.col("f")) & F.col("length").eqNullSafe(F.col("n")) & F.col("files").eqNullSafe(F.col("where"))
    # places of a video are its own: they reach from the first as far as their number says
    reach = vectors.groupBy("video_id").agg((F.max("position") - F.min("position") + 1 - F.count("*")).alias("gap")).agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]
    wrong = found.where(~same).count()
    if wrong or reach or postings.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] != rows:
        raise ValueError(f"{wrong} postings don't say where their video's vectors are")
    return Bundle(f"{root}/{version}/vectors", postings, vectors, told["meta"]["dimension"], told["meta"]["model"])
