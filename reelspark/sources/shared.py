"""Tables written to, and read from, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; in local mode, where it names none, in an own one.  What
    is written there lives as long as the driver's JVM, and is removed when that ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-reelspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/reelspark/{name}-{uuid.uuid4().hex[:12]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    named = jvm.org.apache.hadoop.fs.Path(path)
    files = named.getFileSystem(conf)
    _removed_on_exit(files, named)
    return path


def _removed_on_exit(files, path) -> None:
    """A path is noted only while it is there, so it is made and removed again."""
    files.mkdirs(path)
    files.deleteOnExit(path)
    files.delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 0) in an order: ranges of it are sorted apart and number their own rows; what is
    before a range is a sum over the counts of ranges, one row each."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select("_part", "_first", before.alias("_before"))
    return ranged.join(counts, "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


class Files:
    """The few operations on files that Spark's readers and writers don't do: whole small files that appear at once, renames
    and removals, on whatever file system a path names."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def rename(self, source: str, target: str, overwrite: bool = False) -> None:
        """One step: readers see the old or the new.  Without ``overwrite`` a target that is there is an error."""
        self.rename_all([(source, target)], overwrite)

    def rename_all(self, pairs: list[tuple[str, str]], overwrite: bool = False) -> None:
        """Each (source, target) as ``rename`` does it, some at a time."""
        if not pairs:
            return
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        how[0] = rename.OVERWRITE if overwrite else rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self.path(pairs[0][0])).toUri(), self._conf)
        for folder in {b.rpartition("/")[0] for _, b in pairs}:
            self._fs.mkdirs(self.path(folder))
        one = lambda pair: context.rename(*(self._fs.makeQualified(self.path(x)) for x in pair), how)
        with ThreadPoolExecutor(min(16, len(pairs))) as pool:
            list(pool.map(one, pairs))

    def put(self, name: str, text: str, overwrite: bool = False) -> None:
        """A small file, written aside and renamed."""
        aside = f"{name}.{uuid.uuid4().hex[:8]}.tmp"
        out = self._fs.create(self.path(aside), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            self.rename(aside, name, overwrite)
        except Exception:
            self.remove(aside)
            raise

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)
