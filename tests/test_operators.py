"""Hand-computed cases of the operators, and their kernels."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from reelspark.functions import text
from reelspark.operators import evidence, fusion, joins, ports, vector
from reelspark.operators import sequences as seq
from reelspark.sources import bundles, views
from reelspark.streaming import sessions


def test_reciprocal_ranks(spark):
    rows = [(1, "visual", "shared", 1), (1, "visual", "visual-only", 2), (1, "caption", "caption-only", 1), (1, "caption", "shared", 2)]
    ranked = spark.createDataFrame(rows, "query_id int, source string, frame_id string, rank int")
    got = fusion.reciprocal_rank(ranked, {"visual": 1.0, "caption": 1.0}).orderBy("rank").collect()
    assert [r.frame_id for r in got] == ["shared", "caption-only", "visual-only"]
    assert got[0].fusion_score == round(1 / 61 + 1 / 62, 9)


def test_lost_source_is_made_up_for():
    assert fusion.active_weights({"a": 1.0, "b": 0.5, "c": 0.5}, {"a", "b"}) == {"a": 1.0 * 2 / 1.5, "b": 0.5 * 2 / 1.5}
    assert fusion.active_weights({"a": 1.0}, {"a"}) == {"a": 1.0}


def test_shortlist_counts_coverage_before_votes(spark):
    rows = [(0, "v1", 1), (0, "v2", 2), (0, "v3", 3), (1, "v2", 2), (1, "v3", 1), (2, "v1", 1)]
    hits = spark.createDataFrame([(e, v, r) for e, v, r in rows if (e, v) != (2, "v1")], "event int, video_id string, rank int")
    assert [r.video_id for r in fusion.video_shortlist(hits, "event", k=1, top=2).orderBy("place").collect()] == ["v3", "v2"]


def _aligned(spark, scores, times, penalty=0.0, paths=1, **more):
    rows = [("v", e, f, t, float(row[f])) for e, row in enumerate(scores) for f, t in enumerate(times)]
    scored = spark.createDataFrame(rows, "video_id string, event int, frame_id long, timestamp_ms long, score double")
    out = seq.align_events(scored, ["video_id"], len(scores), penalty, paths, **more).orderBy("path_no").collect()
    return [(r.frame_ids, r.score) for r in out]


def test_alignment(spark):
    t = [0, 1000, 2000, 3000]
    (best, score), (second, _) = _aligned(spark, [[0.1, 0.9, 0.2, 0.2], [0.0, 0.8, 0.5, 0.3]], t, 0.0, 2)
    assert best == [1, 2] and second == [1, 3] and abs(score - 1.4) < 1e-9
    s = [[0.5, 0, 0, 0], [0, 0.4, 0, 0.45]]
    assert _aligned(spark, s, t)[0][0] == [0, 3]
    assert _aligned(spark, s, t, 1e-4)[0][0] == [0, 1]
    assert _aligned(spark, [[0.5], [0.4]], t[:1]) == []
    assert _aligned(spark, [[1.0, 1.0, 1.0, 1.0]] * 2, t, delta=0.5) == []
    assert _aligned(spark, [[1.0, 0.9, 0.0, 0.0], [0.0, 0.1, 0.9, 0.8]], t, delta=0.3)[0][0] == [0, 2]
    assert _aligned(spark, [[0.81, 0.0], [0.0, 0.25]], t[:2], power=0.5)[0] == ([0, 1], 0.9 + 0.5)


@pytest.mark.parametrize("seed", range(3))
def test_alignment_is_the_best_choice(spark, seed):
    from itertools import combinations

    rng = np.random.default_rng(seed)
    s, t = rng.random((3, 7)), np.cumsum(rng.integers(1, 2000, 7)).tolist()
    best = max(sum(s[e, f] for e, f in enumerate(c)) - 1e-4 * (t[c[-1]] - t[c[0]]) for c in combinations(range(7), 3))
    assert abs(_aligned(spark, s.tolist(), t, 1e-4)[0][1] - best) < 1e-9


def test_one_path_of_a_video_before_its_second(spark):
    rows = [(0, v, n, s) for v, n, s in (("a", 1, 0.9), ("a", 2, 0.8), ("a", 3, 0.7), ("b", 1, 0.5), ("b", 2, 0.4))]
    paths = spark.createDataFrame(rows, "task int, video_id string, path_no int, score double")
    short = spark.createDataFrame([(0, "a"), (0, "b")], "task int, video_id string")
    got = seq.diversified(paths, short, "task", 3).orderBy("place").collect()
    assert [(r.video_id, r.path_no) for r in got] == [("a", 1), ("b", 1), ("a", 2)]


def test_early_diversity(spark):
    videos = {"a1": "a", "a2": "a", "a3": "a", "a4": "a", "b1": "b", "c1": "c"}
    rows = [(0, v, f, i + 1) for i, (f, v) in enumerate(videos.items())]
    ranked = spark.createDataFrame(rows, "query_id int, video_id string, frame_id string, rank int")
    places = lambda depth, most: [r.frame_id for r in seq.early_diversity(ranked, "query_id", depth, most).orderBy("place").collect()]
    assert places(5, 2) == ["a1", "a2", "b1", "c1", "a3", "a4"]
    assert places(1, 2) == ["a1", "a2", "a3", "a4", "b1", "c1"]


def test_weights_are_measured(spark):
    ranked = spark.createDataFrame([(0, "visual", "visual", 1), (0, "ocr", "gold", 1)], "query_id int, source string, frame_id string, rank int")
    gold = spark.createDataFrame([(0, "gold")], "query_id int, frame_id string")
    got = fusion.calibrated(ranked, gold, [{"visual": 1.0, "ocr": 0.0}, {"visual": 0.0, "ocr": 1.0}]).orderBy("place").collect()
    assert got[0].weights == {"visual": 0.0, "ocr": 1.0} and got[0].score == 1.0
    assert got[1].score == 0.8


def test_ungrounded_answers_take_no_part(spark):
    columns = "q int, answer_key string, grounded boolean, video_score double, frame_score double, localization double, coverage double, confidence double, video_id string, start_ms int, frame_id string"
    rows = [(0, "2", False, 0.1, 0.1, 0.1, 0.1, 1.0, "v", 0, "f0"), (0, "2", True, 0.1, 0.1, 0.1, 0.1, 0.1, "v", 0, "f1"), (0, "", True, 1.0, 1.0, 1.0, 1.0, 1.0, "v", 0, "f2")]
    got = evidence.answer_ranking(spark.createDataFrame(rows, columns), "q").collect()
    assert [(r.frame_id, r.joint_score, r.consistency) for r in got] == [("f1", 1.0, 1.0)]
    rows = [(0, a, True, v, 0.0, 0.0, 0.0, 0.5, "v", i, f"f{i}") for i, (a, v) in enumerate([("2", 0.0), ("2", 1.0), ("3", 1.0)])]
    got = evidence.answer_ranking(spark.createDataFrame(rows, columns), "q").orderBy("place").collect()
    # video 0, 1, 1; consistency 2/3, 2/3, 1/3 scaled to 1, 1, 0; the other three terms are constant
    assert [(r.frame_id, r.joint_score) for r in got] == [("f1", 1.0), ("f0", 0.8), ("f2", 0.8)]


def test_relations_need_explicit_language(spark):
    said = {"nồi nâu": None, "sau đó B": "BEFORE", "cuối cùng X": "AT_END", "đồng thời B": "OVERLAP", "B trước đó là A": None, "sau khi A, B": None, "ngay trước B": None}
    rows = spark.createDataFrame([(t, p) for t in said for p in (True, False)], "t string, p boolean")
    got = {(r.t, r.p): r.r for r in rows.select("t", "p", text.temporal_relation(F.col("t"), F.col("p")).alias("r")).collect()}
    assert {t: got[t, True] for t in said} == said
    assert {t: got[t, False] for t in said} == {t: r if r == "AT_END" else None for t, r in said.items()}


def test_questions_and_answers(spark):
    asked = {"How many dogs?": "COUNT", "Áo màu gì?": "COLOR", "What does it say?": "TEXT", "Anh ấy nói gì?": "SPEECH", "What happens after?": "TEMPORAL", "Who is it?": "IDENTITY", "Ok": "GENERAL"}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", text.question_kind(F.col("q")).alias("k"), text.question_language(F.col("q")).alias("l")).collect()
    assert {r.q: r.k for r in rows} == asked
    assert {r.q for r in rows if r.l == "vi"} == {"Áo màu gì?", "Anh ấy nói gì?"}
    given = [("Two!", "COUNT", "2"), ("2", "COUNT", "2"), ("mười", "COUNT", "10"), ("two dogs", "COUNT", "two dogs"), ("Two", "COLOR", "two"), ("  Xanh lá! ", "COLOR", "xanh lá"), ("Đỏ", "COLOR", "đỏ")]
    rows = spark.createDataFrame(given, "a string, k string, want string").select("want", text.answer_key(F.col("a"), F.col("k")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_clusters():
    assert seq.bounded_clusters(np.array([0, 10, 20, 30, 100]), 50, 25).tolist() == [0, 0, 0, 1, 2]
    assert seq.anchor_clusters(np.array([[0.0], [0.1], [0.25], [0.3]]), 0.2).tolist() == [0, 0, 1, 1]


def test_suppression():
    assert seq.temporal_nms(np.array([1000, 1400, 4000]), 500).tolist() == [0, 0, 2]
    assert seq.interval_nms(np.array([0, 5, 20]), np.array([10, 15, 30]), 0.4).tolist() == [True, False, True]


def test_folds():
    assert seq.next_fit(np.array([5, 5, 1, 20, 3]), 10).tolist() == [0, 0, 1, 2, 3]
    assert seq.within_budget(np.array([5, 9, 4, 1]), list("abcd"), 10, 9).tolist() == [True, False, True, True]
    assert seq.within_budget(np.array([5, 5, 0, 1, 1]), list("aabcd"), 10, 2).tolist() == [True, False, False, True, False]


def test_gap_repair():
    mask = lambda n, *at: np.isin(np.arange(n), at)
    t = np.array([0, 10, 20, 30])
    assert seq.repaired(t, mask(4, 0, 3), 20).tolist() == [1, 0, 1, 1]
    assert seq.repaired(t, mask(4, 3), 20).tolist() == [1, 0, 1, 1]  # the first is kept, too
    assert seq.repaired(t, mask(4, 1), 20).tolist() == [1, 1, 0, 0]  # nothing after the last given one
    assert seq.repaired(t, mask(4), 20).tolist() == [0, 0, 0, 0]
    assert seq.repaired(np.array([0, 50, 60]), mask(3, 2), 20).tolist() == [1, 0, 2]


def test_thinning():
    t = np.array([0, 100, 200, 300, 900])
    assert seq.thinned(t, np.arange(5) == 2, 200, 200).tolist() == [True, False, True, False, False]
    assert seq.thinned(t, np.arange(5) == 1, 200, 150).tolist() == [True, True, False, True, False]


def test_coverage_anchors():
    t, still, none = np.array([0, 5, 10, 30]), np.zeros(4), np.zeros(4, bool)
    assert seq.coverage_anchors(t, still, none, 1.0, 20, 5).tolist() == [False, False, True, False]
    assert seq.coverage_anchors(t, still, np.arange(4) == 2, 1.0, 21, 5).tolist() == [False, False, False, False]
    assert seq.coverage_anchors(t, np.ones(4), none, 2.0, 14, 6).tolist() == [False, True, True, False]
    assert seq.coverage_anchors(np.array([0, 30, 60]), np.zeros(3), np.zeros(3, bool), 1.0, 20, 5).tolist() == [False, True, True]


def test_dedup_against_the_last_kept_row():
    n = 5
    same = dict(shots=np.zeros(n), motion=np.zeros(n), vectors=np.ones((n, 2)), text=np.zeros(n, bool), within=10, still=0.5, likeness=0.9)
    none = np.zeros(n, bool)
    t = np.array([0, 5, 9, 12, 30])
    assert seq.dedup_against_kept(t, protected=none, **same).tolist() == [True, False, False, True, True]
    assert seq.dedup_against_kept(t, protected=np.arange(n) == 1, **same).tolist() == [True, True, False, False, True]
    same["text"] = np.arange(n) == 2
    assert seq.dedup_against_kept(t, protected=none, **same).tolist() == [True, False, True, True, True]


def test_interpolation(spark):
    rows = [("v", i, x) for i, x in enumerate([None, 1.0, None, 3.0, None])] + [("w", 0, None)]
    out = spark.createDataFrame(rows, "k string, i int, x double").select("k", "i", seq.interpolated("x", "i", "k").alias("y"))
    assert [r.y for r in out.orderBy("k", "i").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0, None]


def test_nearest_frame(spark):
    frames = spark.createDataFrame([("after", 2500, 3), ("in", 1600, 2), ("before", 500, 0), ("later", 1700, 4)], "frame_id string, timestamp_ms long, frame_idx long").selectExpr("'v' video_id", "*")
    segments = spark.createDataFrame([("s1", 1000, 1700), ("s2", 1699, 1700), ("s3", 600, 601)], "segment_id string, start_ms long, end_ms long").selectExpr("'v' video_id", "*")
    got = {r.segment_id: (r.frame_id, r.distance, r.inside) for r in joins.nearest_frame(segments, frames, 0).collect()}
    assert got == {"s1": ("in", 250, True)}
    got = {r.segment_id: (r.frame_id, r.distance, r.inside) for r in joins.nearest_frame(segments, frames, 100).collect()}
    assert got["s2"] == ("later", 1, False) and got["s3"] == ("before", 100, False)


def test_overlap_join_has_no_pair_twice_and_half_open_ends(spark):
    a = spark.createDataFrame([(1, "v", 0, 200_000), (2, "v", 200_000, 200_001), (3, "v", 5, 5)], "l_id int, k string, l_start long, l_end long")
    b = spark.createDataFrame([("x", "v", 10, 190_000), ("y", "v", 199_999, 200_000), ("z", "v", 200_001, 300_000)], "r string, k string, r_start long, r_end long")
    assert sorted((r.l_id, r.r) for r in joins.overlap_join(a, b, "k", 60_000).collect()) == [(1, "x"), (1, "y")]
    left = joins.overlap_join(a, b, "k", 60_000, "left").collect()
    assert sorted((r.l_id, r.r or "") for r in left) == [(1, "x"), (1, "y"), (2, ""), (3, "")]


def test_session_steps():
    out = []
    state = (0, [], None)
    for hint in ("", "a dog", "a dog.", "a dog runs fast", "something else"):
        *state, decision, unit = sessions.step(*state, hint)
        out.append((decision, unit))
    assert out == [("EMPTY", None), ("FIRST", "a dog"), ("NO_CHANGE", None), ("APPEND", "runs fast"), ("REPLACEMENT", None)]
    assert state[0] == 2
    assert sessions.step(2, ["a", "b"], "a b", "a b c", base=2)[3] == "APPEND"
    assert sessions.step(2, ["a", "b"], "a b", "a b c", base=1)[:4] == (2, ["a", "b"], "a b", "CONFLICT")
    assert sessions.step(0, [], None, "a", base=3)[3] == "GONE" and sessions.step(0, [], None, "a", base=0)[3] == "FIRST"


def test_bundles(spark, tmp_path):
    df = spark.range(10)
    bundles.publish({"t": df}, str(tmp_path / "b"), "v1")
    assert bundles.load(spark, str(tmp_path / "b"))["t"].count() == 10
    with pytest.raises(Exception):
        bundles.publish({"t": df}, str(tmp_path / "b"), "v1")
    spark.range(3).write.mode("append").parquet(str(tmp_path / "b/v1/t"))
    with pytest.raises(ValueError):
        bundles.load(spark, str(tmp_path / "b"))


def test_rerank_keeps_order_where_the_scorer_fails(spark):
    ranked = spark.createDataFrame([(1, i, i + 1) for i in range(4)], "query_id int, frame_id int, rank int")

    def broken(batch):
        raise RuntimeError

    assert [r.frame_id for r in ports.rerank(ranked, broken, 3).orderBy("place").collect()] == [0, 1, 2, 3]
    assert [r.frame_id for r in ports.rerank(ranked, lambda b: b["frame_id"].to_numpy(float), 3).orderBy("place").collect()] == [2, 1, 0, 3]


def test_more_queries_than_are_shipped(spark):
    rng = np.random.default_rng(3)
    q, x = rng.integers(-3, 4, (vector.SHIPPED + 50, 3)).astype(float), rng.integers(-3, 4, (5000, 3)).astype(float)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())], "query_id long, query array<double>")
    corpus = spark.createDataFrame([(i, i % 7, v) for i, v in enumerate(x.tolist())], "frame_id long, video_id long, embedding array<double>")
    got = vector.knn_join(queries, corpus, 3).toPandas().sort_values(["query_id", "rank"])
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :3]
    assert got.frame_id.to_numpy().reshape(-1, 3).tolist() == want.tolist()
    assert (got.video_id == got.frame_id % 7).all() and got["rank"].tolist() == [1, 2, 3] * len(q)


def test_best_rows_of_many_batches(spark):
    rng = np.random.default_rng(4)
    q, x = rng.integers(-2, 3, (30, 3)).astype(float), rng.integers(-2, 3, (2000, 3)).astype(float)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())], "query_id long, query array<double>")
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "frame_id long, embedding array<double>").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = vector.knn_join(queries, corpus, 5).toPandas().sort_values(["query_id", "rank"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :5]
    assert got.frame_id.to_numpy().reshape(-1, 5).tolist() == want.tolist()


def test_memory_of_a_search():
    """4096 queries whose first rows are all among their best take little besides these."""
    rng = np.random.default_rng(6)
    best = vector._Best(np.arange(4096), rng.normal(size=(4096, 8)), ["frame_id"], 50, 6)
    batch = pa.RecordBatch.from_pydict({"frame_id": np.arange(3000), "embedding": rng.normal(size=(3000, 8)).tolist()})
    tracemalloc.start()
    try:
        best.add(batch)
        most = tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()
    assert most < 70


def test_a_search_holds_few_scores_at_a_time(spark, monkeypatch):
    """Results do not depend on the sizes of blocks, and no product is of more than BLOCK queries and STEP rows."""
    rng = np.random.default_rng(5)
    q, x = rng.integers(-2, 3, (200, 3)).astype(float), rng.integers(-2, 3, (900, 3)).astype(float)
    ids = rng.permutation(900)
    shape = pa.schema([("query_id", pa.int64()), ("frame_id", pa.int64()), ("score", pa.float64())])
    batch = pa.RecordBatch.from_pydict({"frame_id": ids, "embedding": x[ids].tolist()})
    monkeypatch.setattr(vector, "BLOCK", 16)
    monkeypatch.setattr(vector, "STEP", 32)
    sizes = []
    monkeypatch.setattr(vector.np, "round", lambda a, d, f=np.round: (sizes.append(a.shape), f(a, d))[1])
    best = vector._Best(np.arange(200), q, ["frame_id"], 7, 6)
    best.add(batch)
    assert max(a * b for a, b in sizes) <= 16 * 32 and best.rows.num_rows <= 900
    got = pa.Table.from_batches(best.found(shape)).to_pandas()
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :7]
    assert got.frame_id.to_numpy().reshape(-1, 7).tolist() == want.tolist()
    few = vector._Best(np.arange(200), q, ["frame_id"], 50, 6)
    few.add(batch.slice(0, 20))
    assert pa.Table.from_batches(few.found(shape)).num_rows == 200 * 20


def test_best_rows_are_sorted_out_seldom(monkeypatch):
    """Of 64 steps few sort the best 300 anew, the rows held stay few, and the result is that of all scores."""
    rng = np.random.default_rng(7)
    q, x = rng.normal(size=(64, 4)), rng.normal(size=(16384, 4))
    monkeypatch.setattr(vector, "STEP", 256)
    monkeypatch.setattr(vector, "HELD", 1000, raising=False)
    sorts = []
    monkeypatch.setattr(vector.np, "lexsort", lambda *a, f=np.lexsort, **b: (sorts.append(1), f(*a, **b))[1])
    best = vector._Best(np.arange(64), q, ["frame_id"], 300, 6)
    best.add(pa.RecordBatch.from_pydict({"frame_id": np.arange(len(x)), "embedding": x.tolist()}))
    assert len(sorts) <= 20
    got = pa.Table.from_batches(best.found(pa.schema([("query_id", pa.int64()), ("frame_id", pa.int64()), ("score", pa.float64())]))).to_pandas()
    assert best.rows.num_rows == got.frame_id.nunique()
    want = np.argsort(-np.round(q @ x.T, 6), axis=1, kind="stable")[:, :300]
    assert got.frame_id.to_numpy().reshape(64, 300).tolist() == want.tolist()


def test_a_block_join_gives_few_rows(spark):
    """With many best rows asked for, the corpus is in few parts, as each gives as many of every query."""
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(vector.SHIPPED + 10, 2)), rng.normal(size=(40000, 2))
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())], "query_id long, query array<double>")
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "frame_id long, embedding array<double>")
    shape = StructType([StructField("query_id", LongType()), StructField("frame_id", LongType()), StructField("score", DoubleType())])
    assert vector._block_join(queries, corpus, ["frame_id"], shape, 500, 6).count() <= 2 * len(q) * 500


def test_gold_is_looked_up_for_the_pairs_that_were_found(spark, tmp_path):
    rows = [(i, i % 3 if i < 100 else 7, [1.0]) for i in range(101)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = spark.createDataFrame([(q, x) for q in (0, 20, 100) for x in range(101)] * 2, "query_id long, frame_id long")
    got = sorted((r.query_id, r.frame_id) for r in views.gold_of(spark, str(tmp_path), found).collect())
    assert got == [(q, x) for q in (0, 20) for x in range(100) if x % 3 == q % 3 and x != q]
    assert sorted(r.query_id for r in views.gold_queries(spark, str(tmp_path)).collect()) == [0, 20, 40, 60, 80]


def test_every_pair(spark):
    a, b = spark.range(5).toDF("x"), spark.range(7).toDF("y")
    assert sorted((r.x, r.y) for r in joins.every_pair(a, b).collect()) == [(x, y) for x in range(5) for y in range(7)]


def test_video_ids(spark):
    cases = [
        ("Videos_L26_b/videos/L26_V196/001.mp4", None, "L26_b.L26_V196.001"),
        ("Keyframes_L26_b/keyframes/L26_V196/001/0001.jpg", None, "L26_b.L26_V196.001"),
        ("Videos_L26_b.L26_V196.001", None, "L26_b.L26_V196.001"),
        ("L26_b.L26_V196.001", None, "L26_b.L26_V196.001"),
        ("data/x/Videos_L1/raw/L2\\\\003.webm", None, "L1.L2.003"),
        ("Videos_L1.L2.003.mp4", None, "L1.L2.003"),
        ("L2", "Videos_L1/videos/L2/003.mp4", "L1.L2.003"),
        ("L2", "somewhere/else/x.mp4", "L2"),
        ("", "Videos_L1/videos/L2/003.mp4", "L1.L2.003"),
        ("Videos_L2", None, "L2"),
    ]
    rows = spark.createDataFrame(cases, "given string, fallback string, want string")
    got = rows.select("want", text.video_id(F.col("given"), F.col("fallback")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_short_answers_and_strict_values(spark):
    said = [("<think>hm</think> two\n dogs ", "two dogs"), ("```3```", "3"), ("  ", None), ("x" * 120, "x" * 100)]
    got = spark.createDataFrame(said, "t string, want string").select("want", text.short_answer(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    tokens = {"1": True, "-12": True, "true": False, "1.5": False, '"1"': False, "01": False}
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", text.is_integer(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in got} == tokens


def test_required_sources():
    with pytest.raises(ValueError):
        fusion.active_weights({"a": 1.0, "b": 1.0}, {"b"}, required={"a"})
    with pytest.warns(UserWarning):
        assert fusion.active_weights({"a": 1.0, "b": 1.0}, {"b"}, required={"b"}) == {"b": 2.0}


def test_bundle_versions(spark, tmp_path):
    root, vectors = str(tmp_path / "b"), "id int, v array<double>"
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], vectors)
    bundles.publish({"t": one}, root, "v1", {"dimension": 2})
    with pytest.raises(ValueError):
        bundles.publish({"t": spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], vectors)}, root, "v2", {"dimension": 2})
    assert bundles.load(spark, root)["t"].count() == 2  # the broken version was never pointed to
    bundles.publish({"t": one.limit(1)}, root, "v3", {"dimension": 2})
    assert bundles.load(spark, root)["t"].count() == 1
    bundles.rollback(spark, root, "v1")
    assert bundles.load(spark, root)["t"].count() == 2
    one.withColumn("more", F.lit(1)).write.mode("overwrite").parquet(f"{root}/v1/t")
    with pytest.raises(ValueError):
        bundles.load(spark, root)


def test_sampling_keeps_required_rows(spark):
    rows = [("v", i, i in (1, 2)) for i in range(11)] + [("w", i, False) for i in range(3)]
    got = seq.sampled(spark.createDataFrame(rows, "k string, i int, r boolean"), ["k"], ["i"], 5, "r").collect()
    # even places: 0, 2.5 to 2, 5, 7.5 to 8, 10
    assert sorted((r.k, r.i) for r in got) == [("v", 0), ("v", 1), ("v", 2), ("v", 5), ("v", 8), ("w", 0), ("w", 1), ("w", 2)]


def test_json_subsets_and_required_texts(spark):
    row = spark.range(1).select(F.lit('{"a": {"b": 1, "c": {"d": "x"}}, "e": true}').alias("j"), F.lit(" a  b ").alias("t"), F.lit(" ").alias("blank"))
    has = lambda w: row.select(text.json_has(F.col("j"), w)).first()[0]
    assert has({}) and has({"a": {"b": 1}}) and has({"a": {"c": {"d": "x"}}, "e": "true"})
    assert not has({"a": {"b": 2}}) and not has({"f": 1}) and not has({"a": {"c": {"z": 1}}})
    assert row.select(text.required(F.col("t"), "query")).first()[0] == "a b"
    with pytest.raises(Exception, match="query must not be empty"):
        row.select(text.required(F.col("blank"), "query")).collect()
