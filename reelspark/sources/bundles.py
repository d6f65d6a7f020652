"""Bundles: several tables published together under a version, the manifest last, and loaded only if it agrees."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .shared import Files

#: A table, or what makes one of those that were written before it.
Table = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


def digest(df: DataFrame) -> tuple[int, int]:
    """(rows, a digest that does not depend on their order) of a table."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    row = df.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0))).first()
    return row[0], row[1]


def _written(df: DataFrame, path: str) -> tuple[int, int]:
    """Writes a table; its rows and digest, taken on the way."""
    seen = Observation()
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x")).write.mode("errorifexists").parquet(path)
    return seen.get["n"], seen.get["x"]


def _dimensions(df: DataFrame) -> dict[str, list[int]]:
    """The sizes of the values of each column of vectors, null ones left out."""
    numbers = (FloatType, DoubleType)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, numbers)]
    if not arrays:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(F.size(c))).alias(c) for c in arrays]).first()
    return {c: [n for n in row[c] if n >= 0][:2] for c in arrays}  # one size is right, two are enough to be wrong


def publish(tables: dict[str, Table], root: str, version: str, meta: dict | None = None) -> str:
    """Writes every table under root/version, reads it again and verifies it, then writes the manifest (rows, digest, schema
    and dimensions of each), then the pointer to the newest version, each a file that appears at once.  A version that
    stands is refused, also to the second of two writers; one that broke off has no manifest and is never read.  Vectors of
    a table must be of one dimension, ``meta``'s if it names one."""
    spark, seen, done = next(t for t in tables.values() if isinstance(t, DataFrame)).sparkSession, {}, {}
    for name, df in tables.items():
        path = f"{root}/{version}/{name}"
        rows, hashed = _written(df if isinstance(df, DataFrame) else df(done), path)
        got = done[name] = spark.read.parquet(path)
        if (rows, hashed) != digest(got):
            raise ValueError(f"{name} was not written as it is")
        sizes = _dimensions(got) if meta and "dimension" in meta else {}
        if any(n not in ([], [meta["dimension"]]) for n in sizes.values()):
            raise ValueError(f"{name} has vectors of other dimensions: {sizes}")
        seen[name] = {"rows": rows, "digest": str(hashed), "schema": got.schema.simpleString(), "dimensions": sizes}
    Files(spark, root).put(f"{root}/{version}/manifest.json", json.dumps({"tables": seen, "meta": meta or {}}, sort_keys=True))
    _point(spark, root, version)
    return version


def _point(spark: SparkSession, root: str, version: str) -> None:
    Files(spark, root).put(f"{root}/latest.json", json.dumps({"version": version}), overwrite=True)


def rollback(spark: SparkSession, root: str, version: str) -> None:
    """Points to an earlier version again, if it is whole."""
    load(spark, root, version)
    _point(spark, root, version)


def manifest(spark: SparkSession, root: str, version: str | None = None) -> tuple[str, dict]:
    """(version, its manifest); the newest by default."""
    version = version or json.loads(spark.read.text(f"{root}/latest.json").first()[0])["version"]
    return version, json.loads(spark.read.text(f"{root}/{version}/manifest.json").first()[0])


def load(spark: SparkSession, root: str, version: str | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a version, the newest by default; with ``verify`` their schemas, rows, digests and dimensions are held
    against the manifest."""
    version, told_of = manifest(spark, root, version)
    out = {}
    for name, told in told_of["tables"].items():
        df = spark.read.parquet(f"{root}/{version}/{name}")
        if verify and df.schema.simpleString() != told["schema"]:
            raise ValueError(f"{name} has another schema than its manifest")
        if verify and digest(df) != (told["rows"], int(told["digest"])):
            raise ValueError(f"{name} differs from its manifest")
        if verify and told["dimensions"] and _dimensions(df) != told["dimensions"]:
            raise ValueError(f"{name} has vectors of other dimensions than its manifest")
        out[name] = df
    return out


def todo(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do when work is taken up again."""
    return work.join(done.select(*keys), keys, "left_anti")
