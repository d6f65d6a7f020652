"""Builds of artifacts from tables, in fixed shards that are committed one by one.

Rows are numbered in the order of their key and cut into shards of a fixed number of rows.  A shard is made by one task, in
batches, by a port that may fail: a batch that fails is halved until the failing rows are alone, and these are the shard's
failures.  A shard is committed by renaming its folder to a name that holds the digest of its input, so it is there whole
or not at all.  A later run makes only shards whose number and digest are not there; what an earlier input has left under
another digest is never read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

from ..operators.ports import isolated
from . import shared

#: What makes results of a batch of rows (dicts): as many, in order.
Port = Callable[[list[dict]], list[dict]]
#: Shards of a wave, at most (unless the first is given as larger).
WIDEST = 4096


def _shards(rows: DataFrame, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their shard, number and digest of the rows of each shard)."""
    placed = shared.written(shared.numbered(rows, [F.col(key)], "_position").withColumn("shard", F.expr(f"_position div {size}")), "shards")
    h = F.xxhash64(F.to_json(F.struct("_position", *rows.columns)))
    return placed, placed.groupBy("shard").agg(F.count("*").alias("rows"), F.hex(F.bit_xor(h)).alias("digest"))


def _waves(todo: list[str], first: int) -> list[list[str]]:
    """``todo`` in waves: the first as given, each as large as all before it together, up to WIDEST.  So a few jobs make any
    number of shards, and a run that breaks off loses no more than it has made, or than its first wave."""
    out, at = [], 0
    while at < len(todo):
        size = max(first, min(at, WIDEST))
        out.append(todo[at : at + size])
        at += size
    return out


def build(
    rows: DataFrame, key: str, port: Port, result: str, root: str, size: int = 10_000, batch: int = 64, wave: int = 256,
    most_waves: int | None = None, config: str = "",
) -> dict[str, int]:
    """Brings the artifact at ``root`` up to date with ``rows``: shards, made, reused, completed and failed.

    ``result`` is the DDL of what ``port`` makes of a row.  Shards are made in waves, the first of ``wave`` shards, a wave
    being one job, and committed when it is done, so that a run that breaks off loses a wave at most; ``most_waves`` ends it
    earlier.
    ``config`` is part of a shard's identity: another one makes all anew."""
    spark, files = rows.sparkSession, shared.Files(rows.sparkSession, root)
    placed, shards = _shards(rows, key, size)
    kind = rows.schema[key].dataType
    spec = StructType().add("shard", "long").add(key, kind).add("result", DataType.fromDDL(result)).add("error", "string")
    arrow = to_arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for at in range(0, given.num_rows, batch):
                part = given.slice(at, batch).to_pylist()
                made = isolated(lambda items: port(items), [{k: v for k, v in r.items() if k not in ("shard", "_position")} for r in part])
                out = [{"shard": r["shard"], key: r[key], "result": value, "error": error} for r, (value, error) in zip(part, made)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    identity = hashlib.sha256(f"{config}|{result}|{size}".encode()).hexdigest()[:8]
    name = lambda r: f"{r.shard:08d}-{r.digest}-{identity}"
    wanted = {name(r): r for r in shards.collect()}  # a row for each shard
    there = set(files.names(f"{root}/shards"))
    todo = sorted(set(wanted) - there)
    waves = _waves(todo, wave)[:most_waves]
    for names in waves:
        numbers = [wanted[n].shard for n in names]
        aside = f"{root}/aside-{names[0]}"
        files.remove(aside)  # of a run that broke off
        part = placed.where(F.col("shard").isin(numbers)).repartition("shard").sortWithinPartitions("shard", "_position")
        part.mapInArrow(run, spec).write.partitionBy("shard").parquet(aside)
        files.rename_all([(f"{aside}/shard={wanted[n].shard}", f"{root}/shards/{n}") for n in names])
        files.remove(aside)
    made = sum(map(len, waves))
    state = {"shards": len(wanted), "made": made, "reused": len(wanted) - len(todo)}
    if made == len(todo):
        got = read(rows, root, sorted(wanted), key, result)
        n = got.agg(F.count("*").alias("rows"), F.count("error").alias("failed")).first()
        if n.rows != sum(r.rows for r in wanted.values()):
            raise ValueError("the shards do not cover their input")
        state |= {"completed": n.rows - n.failed, "failed": n.failed}
        files.put(f"{root}/manifest.json", json.dumps({"names": sorted(wanted), **state}), overwrite=True)
    return state


def read(rows: DataFrame, root: str, names: list[str], key: str, result: str) -> DataFrame:
    """key, result and error of the rows of some shards."""
    spark = rows.sparkSession
    schema = StructType().add(key, rows.schema[key].dataType).add("result", DataType.fromDDL(result)).add("error", "string")
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/shards/{n}" for n in names])


def load(rows: DataFrame, root: str, key: str, result: str) -> tuple[DataFrame, DataFrame]:
    """(completed, failures) of the artifact that the manifest names: key and the fields of the result, key and error."""
    told = json.loads(rows.sparkSession.read.text(f"{root}/manifest.json").first()[0])
    got = read(rows, root, told["names"], key, result)
    return got.where("error is null").select(key, "result.*"), got.where("error is not null").select(key, "error")
