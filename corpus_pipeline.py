"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``; other columns of the input, whatever their names, are left behind.

An empty table gives an empty one at every stage.  Rows are documents each, also where they repeat, share a doc_id or have
none; what a stage does for nulls, blank and very long texts and ties is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import common
from reelspark.llm.language_id import language_id
from reelspark.llm.mixing import mix
from reelspark.llm.ngram_jaccard import ngram_jaccard
from reelspark.llm.packing import best_fit_packing
from reelspark.llm.queries import vocabulary
from reelspark.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def _unique(docs: DataFrame) -> DataFrame:
    """``docs`` and ``_given``, its doc_id; where ids repeat (nulls, too), doc_id is the place by id, null first, and text."""
    rows = docs.select(*COLUMNS, F.col("doc_id").alias("_given"))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    rows = common.numbered(rows.withColumn("_text", F.xxhash64("text")), [F.col("doc_id"), F.col("_text")], "unique")
    return rows.select(F.col("position").alias("doc_id"), *COLUMNS[1:], "_given")


def _as_given(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_given").alias("doc_id"), *COLUMNS[1:])


def _by_id(docs: DataFrame) -> DataFrame:
    """The columns of ``_unique`` and ``_id``, the id with null as the smallest."""
    return docs.select(*COLUMNS, "_given", F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("_id"))


def _ids(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("_id"), *more)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts, texts without letters and those below the calibrated score go.  A
    null lang is no label to learn from; whole texts are read."""
    return language_id(docs, keep=tuple(COLUMNS)).where("accepted").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of at least 0.8 over five-word shingles connect, that of the smallest id.
    A null or blank text is like no other, so all of those stay; of equal texts the one of the smallest id stays, a null
    id first, of equal rows one.  Documents that only share an id, or have none, are different ones."""
    docs = _unique(docs)
    groups = ngram_jaccard(docs, k=5, percent=80)
    first = common.table(_ids(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))), "first")
    return _as_given(common.pick(_by_id(docs), first, "_id", "left_semi"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that an earlier document, by id, null first, has; a text of which
    all words go, goes.  A null or blank text and one of fewer words stays as it is."""
    docs = _unique(docs)
    cut = common.table(_ids(substring_dedup(docs).where("n_removed > 0"), "kept_text"), "cut")
    ids, rows = cut.select("_id"), _by_id(docs)
    same = common.pick(rows, ids, "_id", "left_anti")
    changed = common.pick(rows.drop("text"), ids, "_id", "left_semi").join(cut, "_id").where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = changed.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return _as_given(same).unionByName(_as_given(changed))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice.  A null source is a source; null and blank texts have no
    words, and are taken in turn like others."""
    docs = _unique(docs)
    taken = mix(docs).where("copies > 0")
    copies = common.table(_ids(taken, "copies"), "copies")
    rows = common.pick(_by_id(docs), copies, "_id")
    return _as_given(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 2048 tokens; a null text is the end token alone, a long one is
    cut into pieces."""
    return best_fit_packing(docs, vocabulary())


STAGES = [
    ("language ID", identify),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = common.finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.drop(before)
        before = docs
    return docs
