"""Typed evidence of frames: five kinds, each with a declared schema, one version and one lineage, and a manifest that says
so.  What does not keep to it is refused when it is written, and again when it is read."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from . import shared

_FRAME = "frame_id long, video_id string, frame_idx long, timestamp_ms long, frame_store_id string"


@dataclass(frozen=True)
class Kind:
    """The columns of a kind, besides those of a frame; the ones that name a version; the one that holds text to use."""

    columns: str
    versions: tuple[str, ...]
    text: str
    children: str | None = None

    @property
    def schema(self) -> StructType:
        return DataType.fromDDL(f"{_FRAME}, {self.columns}")


_STATUS = "status string, error string, artifact_version string"
KINDS = {
    "caption": Kind(f"caption_text string, {_STATUS}", ("artifact_version",), "caption_text"),
    "ocr": Kind(f"ocr_text string, quality double, {_STATUS}", ("artifact_version",), "ocr_text", "frame_id long, region_id string, region_order int, text string, confidence double"),
    "object": Kind(f"counts_json string, summary string, {_STATUS}", ("artifact_version",), "summary"),
    "context": Kind(
        "context_text string, context_version string, caption_version string, ocr_version string, object_version string",
        ("context_version", "caption_version", "ocr_version", "object_version"),
        "context_text",
    ),
    "asr": Kind(f"transcript_text string, start_ms long, end_ms long, {_STATUS}", ("artifact_version",), "transcript_text"),
}
STATES = ("completed", "failed", "skipped")


def _checked(rows: DataFrame, kind: str) -> dict:
    """The number, the lineage and the versions of rows that keep to their kind."""
    spec = KINDS[kind]
    given, wanted = [(f.name, f.dataType) for f in rows.schema.fields], [(f.name, f.dataType) for f in spec.schema.fields]
    if given != wanted:
        raise ValueError(f"{kind} has the columns {given}, not {wanted}")
    uniform = ["frame_store_id", *spec.versions]
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    ids = ["frame_id", "video_id", "frame_idx", "timestamp_ms"]
    blank = F.lit(False)
    for c in uniform:
        blank = blank | F.col(c).isNull() | (F.trim(c) == "")
    state = ~F.col("status").isin(*STATES) if "status" in rows.columns else F.lit(False)
    row = rows.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("frame_id")).alias("repeated frames"),
        n(F.greatest(*[F.col(c).isNull() for c in ids])).alias("rows without a frame"),
        n(blank).alias("rows without a lineage or version"),
        n(F.coalesce(state, F.lit(True))).alias("rows of an unknown status"),
        *[F.min(c).alias(f"min {c}") for c in uniform],
        *[F.max(c).alias(f"max {c}") for c in uniform],
    ).first()
    wrong = {c: row[c] for c in ("repeated frames", "rows without a frame", "rows without a lineage or version", "rows of an unknown status") if row[c]}
    wrong |= {f"several of {c}": (row[f"min {c}"], row[f"max {c}"]) for c in uniform if row[f"min {c}"] != row[f"max {c}"]}
    if wrong:
        raise ValueError(f"{kind}: {wrong}")
    return {"kind": kind, "rows": row["rows"], **{c: row[f"min {c}"] for c in uniform}}


def write(rows: DataFrame, kind: str, path: str, children: DataFrame | None = None, empty: dict | None = None) -> dict:
    """Writes the rows of a kind, their child rows if it has such, then the manifest, whose content it gives.  An empty table
    has no rows to tell its lineage and versions, so ``empty`` must."""
    spec, files = KINDS[kind], shared.Files(rows.sparkSession, path)
    if (children is None) != (spec.children is None):
        raise ValueError(f"{kind} has {'no ' if spec.children is None else ''}child rows")
    told = _checked(rows, kind)
    if not told["rows"]:
        told |= empty or {}
        if any(not told[c] for c in ("frame_store_id", *spec.versions)):
            raise ValueError(f"an empty {kind} must be told its lineage and versions")
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    if children is not None:
        if children.schema.simpleString() != DataType.fromDDL(spec.children).simpleString():
            raise ValueError(f"children of {kind} have the columns {children.schema.simpleString()}")
        orphans = children.join(rows.select("frame_id"), "frame_id", "left_anti")
        if not orphans.isEmpty():
            raise ValueError(f"{kind} has child rows without a parent")
        children.write.mode("errorifexists").parquet(f"{path}/children")
    files.put(f"{path}/manifest.json", json.dumps(told, sort_keys=True))
    return told


def read(spark: SparkSession, kind: str, path: str, lineage: str | None = None, version: str | None = None) -> DataFrame:
    """The rows of a kind, which were held against the declared schema, the manifest, and ``lineage`` and ``version`` (of its
    first version column) if they are given.  Parquet reads only the columns that are used later."""
    told = json.loads(spark.read.text(f"{path}/manifest.json").first()[0])
    if told["kind"] != kind:
        raise ValueError(f"{path} holds {told['kind']}, not {kind}")
    rows = spark.read.parquet(f"{path}/rows")
    seen = _checked(rows, kind)
    differ = {c: (v, told[c]) for c, v in seen.items() if v != told[c] and not (v is None and not seen["rows"])}
    wanted = {"frame_store_id": lineage, KINDS[kind].versions[0]: version}
    differ |= {c: (told[c], w) for c, w in wanted.items() if w is not None and told[c] != w}
    if differ:
        raise ValueError(f"{kind} at {path} differs from what is told or asked: {differ}")
    return rows


def children(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.schema(DataType.fromDDL(KINDS[kind].children)).parquet(f"{path}/children")


def usable(rows: DataFrame, kind: str) -> DataFrame:
    """frame_id and text of rows that are complete and not blank."""
    rows = rows.where("status = 'completed'") if "status" in rows.columns else rows
    text = F.col(KINDS[kind].text)
    return rows.where(F.trim(text) != "").select("frame_id", text.alias("text"))


def covers(rows: DataFrame, frames: DataFrame) -> dict[str, int]:
    """How many frames (frame_id) have no row, and how many rows have no frame."""
    ids = rows.select("frame_id")
    missing, foreign = frames.select("frame_id").join(ids, "frame_id", "left_anti").count(), ids.join(frames, "frame_id", "left_anti").count()
    if missing or foreign:
        raise ValueError(f"{missing} frames have no evidence, {foreign} rows no frame")
    return {"missing": missing, "foreign": foreign}
