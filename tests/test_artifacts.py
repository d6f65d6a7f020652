"""Bundles with postings, builds in shards and typed evidence: what is read, what is refused, what a broken run leaves."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from reelspark.sources import builds, bundles, shared, typed, vectors


def _vectors(spark):
    rows = [(i, i % 9, 100 * i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(300)]
    return spark.createDataFrame(rows, "frame_id long, video_id long, timestamp_ms long, embedding array<float>").repartition(4)


def test_a_search_reads_posted_files_only(spark, tmp_path):
    root = str(tmp_path / "b")
    vectors.save(_vectors(spark), root, "v1", "m", file_rows=40)
    bundle = vectors.load(spark, root)
    assert (bundle.dimension, bundle.model) == (2, "m")
    told = {r.video_id: r for r in bundle.postings.collect()}
    assert [(told[v].first, told[v].length) for v in range(9)] == [(sum(len(range(u, 300, 9)) for u in range(v)), len(range(v, 300, 9))) for v in range(9)]
    every, some = len(bundle.rows().inputFiles()), bundle.rows([0, 1])
    assert {os.path.basename(f) for f in some.inputFiles()} == {*told[0].files, *told[1].files} and len(some.inputFiles()) < every / 2
    assert {r.frame_id for r in bundle.rows([0, 1], 500, 2000).collect()} == {i for i in range(5, 21) if i % 9 < 2}
    assert bundle.rows([77]).count() == 0
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    assert [r.frame_id for r in bundle.search(asked, 3, [0, 1]).orderBy("rank").collect()] == [1, 9, 19]


@pytest.mark.parametrize("spoilt", ["first", "length", "files"])
def test_broken_postings_are_refused(spark, tmp_path, spoilt):
    root = str(tmp_path / "b")
    rows = shared.numbered(_vectors(spark), [F.col("video_id"), F.col("frame_id")])
    wrong = {"first": F.col("first") + F.when(F.col("video_id") == 3, 1).otherwise(0), "length": F.col("length") - 1, "files": F.array(F.lit("x.parquet"))}[spoilt]
    bundles.publish({"vectors": rows, "postings": lambda done: vectors._postings(done["vectors"]).withColumn(spoilt, wrong)}, root, "v1", {"dimension": 2, "model": "m"})
    with pytest.raises(ValueError, match="postings"):
        vectors.load(spark, root)


def test_vectors_that_are_no_index_are_refused(spark, tmp_path):
    for n, bad in enumerate([_vectors(spark).withColumn("embedding", F.expr("transform(embedding, x -> cast(x * 2 as float))")), _vectors(spark).withColumn("frame_id", F.lit(1).cast("long"))]):
        vectors.save(bad, str(tmp_path / f"{n}"), "v1", "m")
        with pytest.raises(ValueError, match="no index"):
            vectors.load(spark, str(tmp_path / f"{n}"))
    bundles.publish({"vectors": _vectors(spark)}, str(tmp_path / "half"), "v1")
    with pytest.raises(ValueError, match="postings"):
        vectors.load(spark, str(tmp_path / "half"))


def test_pointer_and_manifest_appear_at_once(spark, tmp_path):
    root = str(tmp_path / "b")
    files = shared.Files(spark, root)
    files.put(f"{root}/x.json", "1")
    with pytest.raises(Exception):
        files.put(f"{root}/x.json", "2")
    files.put(f"{root}/x.json", "3", overwrite=True)
    assert files.names(root) == ["x.json"] and open(f"{root}/x.json").read() == "3"
    bundles.publish({"t": spark.range(3)}, root, "v1")
    # a second writer of the same version finds the manifest there, whatever it has written
    with pytest.raises(Exception):
        files.put(f"{root}/v1/manifest.json", "{}")
    bundles.publish({"t": spark.range(4)}, root, "v2")
    bundles.rollback(spark, root, "v1")
    assert bundles.load(spark, root)["t"].count() == 3


def _port(rows):
    if any(r["n"] % 23 == 5 for r in rows):
        raise ValueError("bad row")
    return [{"twice": 2 * r["n"]} for r in rows]


def _content(df, root):
    done, failed = builds.load(df, root, "id", "twice long")
    return {r.id: r.twice for r in done.collect()}, {r.id: r.error for r in failed.collect()}


def test_a_build_that_was_broken_off_ends_as_one_that_was_not(spark, tmp_path):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7).alias("n")).repartition(5)
    whole, broken = str(tmp_path / "a"), str(tmp_path / "b")
    state = builds.build(df, "id", _port, "twice long", whole, size=40, batch=16)
    bad = {i for i in range(500) if i * 7 % 23 == 5}
    assert state == {"shards": 13, "made": 13, "reused": 0, "completed": 500 - len(bad), "failed": len(bad)}
    for waves in range(1, 4):
        assert builds.build(df, "id", _port, "twice long", broken, size=40, wave=3, most_waves=1)["reused"] == 3 * (waves - 1)
    # a wave that broke off before its commit leaves a folder aside, which is not read
    left = sorted(os.listdir(f"{broken}/shards"))
    shutil.copytree(f"{broken}/shards/{left[0]}", f"{broken}/aside-{sorted(set(os.listdir(f'{whole}/shards')) - set(left))[0]}/shard=9")
    again = builds.build(df, "id", _port, "twice long", broken, size=40, wave=3)
    assert (again["made"], again["reused"]) == (4, 9)
    assert _content(df, whole) == _content(df, broken) == ({i: 14 * i for i in range(500) if i not in bad}, {i: "ValueError: bad row" for i in bad})
    assert sorted(os.listdir(f"{whole}/shards")) == sorted(os.listdir(f"{broken}/shards"))
    # changed rows make their shards anew, and only those; so does another configuration, of all
    changed = df.withColumn("n", F.when(F.col("id") == 81, 1).otherwise(F.col("n")))
    assert builds.build(changed, "id", _port, "twice long", whole, size=40)["made"] == 1 and _content(df, whole)[0][81] == 2
    assert builds.build(changed, "id", _port, "twice long", whole, size=40, config="v2")["made"] == 13
    assert builds.build(df.limit(0), "id", _port, "twice long", str(tmp_path / "c"), size=40) == {"shards": 0, "made": 0, "reused": 0, "completed": 0, "failed": 0}


def _captions(spark, **change):
    row = {"frame_id": 1, "video_id": "v", "frame_idx": 0, "timestamp_ms": 0, "frame_store_id": "s", "caption_text": "a dog", "status": "completed", "error": None, "artifact_version": "v1"}
    return spark.createDataFrame([tuple({**row, "frame_id": i, **(change if i == 2 else {})}.values()) for i in range(4)], typed.KINDS["caption"].schema)


def test_typed_evidence_is_what_it_says(spark, tmp_path):
    path = str(tmp_path / "c")
    told = typed.write(_captions(spark, status="failed"), "caption", path)
    assert told == {"kind": "caption", "rows": 4, "frame_store_id": "s", "artifact_version": "v1"}
    got = typed.read(spark, "caption", path, "s", "v1")
    assert sorted(r.frame_id for r in typed.usable(got, "caption").collect()) == [0, 1, 3]
    assert typed.covers(got, spark.range(4).withColumnRenamed("id", "frame_id")) == {"missing": 0, "foreign": 0}
    for frames in (spark.range(5), spark.range(3)):
        with pytest.raises(ValueError):
            typed.covers(got, frames.withColumnRenamed("id", "frame_id"))
    plan = got.select("frame_id")._jdf.queryExecution().executedPlan().toString()
    assert "caption_text" not in plan
    for kind, lineage, version in (("ocr", None, None), ("caption", "other", None), ("caption", "s", "v2")):
        with pytest.raises(ValueError):
            typed.read(spark, kind, path, lineage, version)


@pytest.mark.parametrize("change", [{"artifact_version": "v2"}, {"frame_store_id": "t"}, {"frame_store_id": None}, {"artifact_version": " "}, {"frame_id": 1}, {"frame_id": None}, {"status": "done"}, {"status": None}])
def test_mixed_or_broken_evidence_is_refused(spark, tmp_path, change):
    with pytest.raises(ValueError):
        typed.write(_captions(spark, **change), "caption", str(tmp_path / "c"))
    # the same when such rows come in behind the manifest
    path = str(tmp_path / "d")
    typed.write(_captions(spark), "caption", path)
    _captions(spark, **change).where("frame_id is null or frame_id <= 2").write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError):
        typed.read(spark, "caption", path)


def test_schemas_children_and_empty_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="columns"):
        typed.write(_captions(spark).withColumn("more", F.lit(1)), "caption", str(tmp_path / "a"))
    empty = _captions(spark).limit(0)
    with pytest.raises(ValueError, match="empty"):
        typed.write(empty, "caption", str(tmp_path / "b"))
    told = typed.write(empty, "caption", str(tmp_path / "c"), empty={"frame_store_id": "s", "artifact_version": "v1"})
    assert typed.read(spark, "caption", str(tmp_path / "c"), "s").count() == 0 and told["rows"] == 0
    ocr = spark.createDataFrame([(1, "v", 0, 0, "s", "a\nb", 0.5, "completed", None, "v1")], typed.KINDS["ocr"].schema)
    child = lambda *ids: spark.createDataFrame([(i, f"{i}:0", 0, "a", 0.5) for i in ids], typed.KINDS["ocr"].children)
    with pytest.raises(ValueError, match="parent"):
        typed.write(ocr, "ocr", str(tmp_path / "d"), child(1, 2))
    with pytest.raises(ValueError, match="child"):
        typed.write(ocr, "ocr", str(tmp_path / "e"))
    typed.write(ocr, "ocr", str(tmp_path / "f"), child(1))
    assert typed.children(spark, "ocr", str(tmp_path / "f")).count() == 1
    with open(tmp_path / "f" / "manifest.json") as f:
        assert json.load(f)["kind"] == "ocr"


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = shared.numbered(df, [F.col("v")]).collect()
    assert all(r.position == r.v for r in got) and len(got) == 1000


def test_a_build_of_many_shards_takes_few_jobs(spark, tmp_path):
    assert [len(w) for w in builds._waves(list(range(6000)), 4)] == [4, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 1904]
    df = spark.range(120).select(F.col("id"), F.col("id").alias("n"))
    spark.sparkContext.setJobGroup("many-shards", "")
    try:
        state = builds.build(df, "id", lambda rows: [{"twice": 2 * r["n"]} for r in rows], "twice long", str(tmp_path / "a"), size=2, wave=1)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many-shards"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (state["shards"], state["made"], state["completed"]) == (60, 60, 120) and jobs < 60
