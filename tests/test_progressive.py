"""Relations, progressive evidence, sessions, budgeted answers and JSON in free text, on cases."""

import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import text
from reelspark.operators import evidence, fusion, ports, progressive, sequences, traces, vector
from reelspark.streaming import sessions
from reelspark.streaming.sessions import Store, replay

SCENE = ["task", "video_id", "scene"]


def _evidence(spark, rows):
    return spark.createDataFrame([(1, 1, 0, u, t, s) for u, t, s in rows], "task int, video_id int, scene int, event int, timestamp_ms long, score double")


def _constraints(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "task int, relation string, subject int, object int")


def _outcomes(spark, rows, constraints, near=1000):
    out = evidence.relation_outcomes(_evidence(spark, [(u, t, 0.8) for u, t in rows]), _constraints(spark, constraints), SCENE, ["task"], "event", "timestamp_ms", near)
    return {(r.relation, r.subject, r.object): r.holds for r in out.collect()}, evidence.relation_scores(out, SCENE).collect()


def test_any_valid_pair_of_times_holds(spark):
    interleaved = [(0, 10_000), (0, 100_000), (1, 5_000), (1, 50_000)]
    got, scores = _outcomes(spark, interleaved, [("BEFORE", 0, 1), ("AFTER", 0, 1), ("OVERLAP", 0, 1), ("AT_END", 0, None), ("AT_END", 1, None), ("BEFORE", 0, 2), ("BEFORE", 0, None)])
    assert got == {("BEFORE", 0, 1): True, ("AFTER", 0, 1): True, ("OVERLAP", 0, 1): False, ("AT_END", 0, None): True, ("AT_END", 1, None): False, ("BEFORE", 0, 2): None, ("BEFORE", 0, None): False}
    assert [(r.related, r.unknown) for r in scores] == [(0.5, 1)]
    assert _outcomes(spark, interleaved, [("OVERLAP", 0, 1), ("NEAR", 1, 0)], 5000)[0] == {("OVERLAP", 0, 1): True, ("NEAR", 1, 0): True}
    got, scores = _outcomes(spark, [(0, 10_000)], [("BEFORE", 0, 1)])
    assert got == {("BEFORE", 0, 1): None} and [(r.related, r.unknown) for r in scores] == [(None, 1)]


def test_outcomes_against_every_pair(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(4), rng.randrange(0, 60_000, 500)) for _ in range(40)]
    given = [(r, a, b) for r in ("BEFORE", "AFTER", "OVERLAP", "NEAR") for a in range(5) for b in range(5)]
    got = _outcomes(spark, rows, given, 700)[0]
    for r, a, b in given:
        pairs = [(x, y) for u, x in rows if u == a for v, y in rows if v == b]
        test = {"BEFORE": lambda x, y: x <= y, "AFTER": lambda x, y: x >= y}.get(r, lambda x, y: abs(x - y) <= 700)
        assert got[r, a, b] == (any(test(*p) for p in pairs) if pairs else None), (r, a, b)


def test_scene_terms(spark):
    e = _evidence(spark, [(0, 1000, 0.6), (1, 2000, 0.6)])
    seen = spark.createDataFrame([(1, 1, 0), (1, 1, 1)], "task int, video_id int, event int")
    none = _constraints(spark, [("NEAR", 5, 6)]).limit(0)
    row = evidence.scene_scores(e, seen, none, "task", "event", "scene", 2).first()
    assert (row.coverage, row.evaluation, row.related, row.semantic) == (1.0, 1.0, None, 1.0)
    assert row.score == pytest.approx((0.45 + 0.30 + 0.15 / (1 + 1000 / 15000)) / 0.9)
    told = evidence.scene_scores(e, seen, _constraints(spark, [("BEFORE", 1, 0)]), "task", "event", "scene", 2).first()
    assert told.related == 0.0 and told.score == pytest.approx(0.45 + 0.30 + 0.15 / (1 + 1000 / 15000))
    # one of two units was looked for: what is unknown lowers the evaluation, not the coverage
    half = evidence.scene_scores(e.where("event = 0"), seen.where("event = 0"), none, "task", "event", "scene", 2).first()
    assert (half.coverage, half.evaluation) == (1.0, 0.5)


def _plain_states(hints, frames, budget):
    """The same steps, hint by hint and session by session, on lists and dicts."""
    sessions = {}
    for q, vector, task, event in sorted(hints, key=lambda h: (h[2], h[3])):
        evaluated, found, pool, units = sessions.setdefault(task, (set(), {}, [], []))
        units.append(vector)

        def search(v, videos, k):
            rows = [(-round(float(np.dot(v, x)), 6), f, video, t) for f, video, t, x in frames if videos is None or video in videos]
            return [(video, f, t, -s) for s, f, video, t in sorted(rows)[:k] if -s >= budget.least]

        def keep(event, video, rows):
            evaluated.add((event, video))
            best = sorted({(-s, t, f) for v, f, t, s in rows if v == video})[: budget.kept]
            if best:
                found[event, video] = best

        rows = search(vector, None, budget.everywhere) + (search(vector, set(pool), budget.within) if pool else [])
        seen = list(dict.fromkeys(r[0] for r in rows))
        for video in seen:
            keep(event, video, rows)
        lacks = lambda video: [e for e in range(len(units)) if (e, video) not in evaluated]
        targets = [v for v in seen if v not in pool] + [v for v in pool if lacks(v)]
        for video in targets[: budget.backfill_videos]:
            for e in lacks(video)[: budget.backfill_hints]:
                keep(e, video, search(units[e], {video}, 10**9))
        videos = set(pool) | set(seen)
        best = {k: -v[0][0] for k, v in found.items()}
        span = {e: (min(0.0, *(s for (u, _), s in best.items() if u == e)), max(s for (u, _), s in best.items() if u == e)) for e in {u for u, _ in best}}
        score = {}
        for v in videos:
            own = [(s, *span[u]) for (u, w), s in best.items() if w == v]
            scaled = [1.0 if high <= low else (s - low) / (high - low) for s, low, high in own]
            asked = sum(1 for _, w in evaluated if w == v)
            a, b, c = budget.weights
            score[v] = round(a * round(sum(scaled) / len(scaled), 9) if scaled else 0.0, 12) + (b * len(scaled) + c * asked) / len(units)
        pool[:] = sorted(videos, key=lambda v: (-round(score[v], 12), v))[: budget.pool]
        evaluated -= {p for p in evaluated if p[1] not in pool}
        for k in [k for k in found if k[1] not in pool]:
            del found[k]
    return sessions


def test_steps_against_a_plain_replay(spark):
    rng = np.random.default_rng(11)
    frames = [(i, i // 7, 1000 * (i % 7), rng.normal(0, 1, 6).round(3).tolist()) for i in range(140)]
    hints = [(10 * s + e, rng.normal(0, 1, 6).round(3).tolist(), s, e) for s in range(5) for e in range([5, 3, 1, 5, 2][s])]
    corpus = spark.createDataFrame(frames, "frame_id long, video_id long, timestamp_ms long, embedding array<double>")
    asked = spark.createDataFrame(hints, "query_id long, query array<double>, task long, event int")
    budget = progressive.Budget(everywhere=10, within=6, kept=2, backfill_videos=2, backfill_hints=2, pool=5, least=3.0)
    state = progressive.acquire(asked, corpus, budget)
    want = _plain_states(hints, frames, budget)
    assert {(r.task, r.event, r.video_id) for r in state.evaluated.collect()} == {(t, *p) for t, s in want.items() for p in s[0]}
    assert {(r.task, r.event, r.video_id, r.frame_id, r.score) for r in state.found.collect()} == {(t, e, v, f, -s) for t, x in want.items() for (e, v), rows in x[1].items() for s, _, f in rows}
    pools = {}
    for r in state.pool.orderBy("task", "place").collect():
        pools.setdefault(r.task, []).append(r.video_id)
    assert pools == {t: s[2] for t, s in want.items()}
    kinds = {r.state for r in progressive.states(state, asked).collect()}
    assert kinds == {"MATCH", "NO_MATCH", "UNKNOWN"}
    # what was said of the hints changes the order of scenes
    units = asked.groupBy("task").agg(F.count("*").alias("units"))
    order = lambda given: [(r.task, r.place, r.video_id, r.scene) for r in progressive.aligned(state, spark.createDataFrame(given, "task long, relation string, subject int, object int"), units).orderBy("task", "place").collect()]
    said = [(t, "AT_END", 0, None) for t in range(5)] + [(t, "BEFORE", 1, 0) for t in range(5)]
    assert order(said) != order([(99, "BEFORE", 0, 1)])


def test_sessions_commit_expire_and_are_put_out():
    store = Store(life_ms=10, most=2)
    assert store.say(1, 100, "H1") == (1, "FIRST", "H1", 1, [])
    assert store.say(1, 101, "H1 H2", base=1)[:2] == (2, "APPEND")
    assert store.say(1, 101, "H1 H2 H3", base=1)[:2] == (2, "CONFLICT")
    # a look doesn't renew a session's life, a commit has
    assert store.say(1, 109, "H1 H2.", base=2)[:2] == (2, "NO_CHANGE")
    assert store.cleaned(110) == 0 and store.cleaned(111) == 1
    assert store.say(1, 111, "H1 H2 H3", base=2)[1] == "GONE"
    assert store.say(1, 112, "anew")[1] == "FIRST"
    # the least recently used goes: 1 was looked at after 2 was made
    assert store.say(2, 113, "b")[4] == [] and store.say(1, 114, "anew")[1] == "NO_CHANGE"
    assert store.say(3, 115, "c")[4] == [2] and store.say(2, 116, "b b", base=1)[1] == "GONE"
    assert store.say(3, 117, "c d", context="vqa")[1] == "CONFLICT"
    again = Store(10, 2, store.text())
    assert list(again.sessions) == list(store.sessions) and again.say(1, 118, "anew it is", base=1)[1] == "APPEND"


def test_replay_of_stores(spark):
    rows = [(1, s, 1000 * k + s, k, " ".join("abcdefgh"[: k + 1]), None, None) for s in range(5) for k in range(4)]
    df = spark.createDataFrame(rows, "store long, session long, at long, seq long, hint string, base int, context string")
    got = replay(df, most=3).collect()
    # five sessions take turns in a store of three, so each is put out before it is heard again
    assert {r.decision for r in got} == {"FIRST"} and sum(len(r.evicted) for r in got) == 17
    assert [r.decision for r in replay(df, most=5).orderBy("session", "seq").collect()] == ["FIRST", "APPEND", "APPEND", "APPEND"] * 5
    late = df.withColumn("at", F.col("seq") * 10**7)
    assert {r.decision for r in replay(late, most=5).collect()} == {"FIRST"}


def test_calls_stay_within_the_budget(spark):
    rows = [(q, kind, place, f"{q}{place}", [place], [place, place + 1] if place != 3 else None) for q, kind in ((1, "TEMPORAL"), (2, "COUNT")) for place in range(1, 6)]
    windows = spark.createDataFrame(rows, "question int, kind string, place int, text string, frames array<long>, wide array<long>")

    def model(texts, kinds, frames):
        if any(t in ("12", "24") for t in texts):
            raise RuntimeError("no picture")
        sure = [0.1 if t in ("11", "13") else 0.9 for t in texts]
        return [t.upper() for t in texts], [99 if t == "22" else f[-1] for t, f in zip(texts, frames)], sure

    for most in (1, 2, 3, 4, 8):
        got = ports.answer(windows, model, most).orderBy("question", "call").collect()
        assert max(r.call for r in got) <= most
    said = [(r.question, r.place, r.call, r.retried, r.answer, r.frame_id, list(r.warnings)) for r in got]
    again = ["temporal_neighbor_fallback"]
    assert said == [
        (1, 1, 1, False, "11", 1, []), (1, 1, 2, True, "11", 2, again),
        (1, 2, 3, False, None, None, ["RuntimeError: no picture"]), (1, 2, 4, True, None, None, again + ["RuntimeError: no picture"]),
        (1, 3, 5, False, "13", 3, []), (1, 4, 6, False, "14", 4, []), (1, 5, 7, False, "15", 5, []),
        (2, 1, 1, False, "21", 1, []), (2, 2, 2, False, None, None, ["frame_not_shown"]), (2, 3, 3, False, "23", 3, []),
        (2, 4, 4, False, None, None, ["RuntimeError: no picture"]), (2, 5, 5, False, "25", 5, []),
    ]


def test_failing_items_are_found_alone():
    calls = []

    def call(items):
        calls.append(len(items))
        if any(i % 10 == 3 for i in items):
            raise ValueError(f"bad\nand more")  # noqa: F541
        return [i * i for i in items]

    got = ports.isolated(call, list(range(32)))
    assert got == [(None, "ValueError: bad") if i % 10 == 3 else (i * i, None) for i in range(32)]
    assert len(calls) < 32 and ports.isolated(call, []) == []
    assert ports.isolated(lambda items: [1], [0, 1, 2])[0] == (1, None)  # too few results are a failure of the batch, not of one


def test_json_in_free_text(spark):
    said = {
        '{"a":{"k":1},"k":2}': '{"a":{"k":1},"k":2}', 'x {"s":"} {\\" {"} y': '{"s":"} {\\" {"}', "{broken {\"k\": 1}": '{"k":1}', "none": None, "[1, 2]": None,
        '{"n": NaN} {"m": [1, {"é": null}]}': '{"m":[1,{"é":null}]}', "": None,
    }
    df = spark.createDataFrame([(k,) for k in said] + [(None,)], "t string")
    got = {r.t: r.o for r in df.select("t", text.first_object(F.col("t")).alias("o")).collect()}
    assert got == {**said, None: None}
    full = json.dumps({"answer": " a  b ", "selected_frame_id": 7, "confidence": "0.75"})
    cases = [(full, ("a b", "7", True, 0.75)), ('{"answer":"x"} ' + full, ("a b", "7", True, 0.75)), ('{"answer":"x","selected_frame_id":"f","answerable":"no"}', None), ('{"answer":"x","selected_frame_id":"f","confidence":1.5}', None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", text.grounded_answer(F.col("t")).alias("g")).collect()
    assert {r.i: r.g and tuple(r.g) for r in rows} == {i: want for i, (_, want) in enumerate(cases)}


def test_submissions(spark):
    frames = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 2, 0)], "frame_id int, video_id int, frame_idx int")
    ranked = spark.createDataFrame([(7, 1, 1, "a", 1), (7, 3, 1, "a", 2), (7, 9, 1, "a", 3), (7, 1, 1, "a", 4), (7, 1, 1, "b", 5), (7, 2, 1, "a", 6)], "query_id int, frame_id int, video_id int, answer string, rank int")
    got = [(r.rank, r.frame_id, r.answer) for r in fusion.submissions(ranked, frames, 2).orderBy("rank").collect()]
    assert got == [(1, 1, "a"), (2, 1, "b")]
    with pytest.raises(ValueError):
        fusion.submissions(ranked, frames, 101)


def test_folds_cut_partitions_at_keys(spark):
    rows = [(k, i, (k or 0) * 100 + i) for k in [None, *range(40)] for i in range((k or 3) * 7 % 23)]
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sequences.fold(df, ["k"], ["i"], "n", "long", lambda p: np.cumsum(p["v"].to_numpy())).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.k is not None, r.k or 0, r.i, r.n) for r in got) == sorted((k is not None, k or 0, i, sum(v for j, x, v in rows if j == k and x <= i)) for k, i, _ in rows)


def test_coverage_anchors_against_a_scan():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        times = np.sort(rng.integers(0, 20_000, n))
        motion, marked = rng.random(n) * rng.choice([0.5, 2]), rng.random(n) < rng.choice([0, 0.1, 0.4])
        threshold = float(rng.choice([0.0, 0.5, 1.0]))
        want, last = np.zeros(n, bool), 0
        for i in range(1, n):
            calm = min(motion[i] / threshold, 1.0) if threshold else float(motion[i] > 0)
            if times[i] - times[last] >= round(3000 - calm * 2000):
                last = max(i - 1, last + 1)
                want[last] = True
            last = i if marked[i] else last
        assert (sequences.coverage_anchors(times, motion, marked, threshold, 3000, 1000) == want).all()


def test_traces(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "request int, stage string, duration_ms double")
    merged = traces.merged({"": rows((1, "fusion", 5.0)), "global": rows((1, "retrieval", 2.0), (2, "search", 3.0)), "local.a": rows((1, "search", 4.0))})
    assert {(r.request, r.stage) for r in merged.collect()} == {(1, "fusion"), (1, "global.retrieval"), (2, "global.search"), (1, "local.a.search")}
    got = {r.stage: (r.requests, r.total_ms, r.slowest_ms) for r in traces.durations(merged, ["retrieval", "absent"]).collect()}
    assert got == {"search": (2, 9.0, 4.0)}
    with pytest.raises(Exception, match="there twice"):
        traces.merged({"a": rows((1, "x", 1.0)), "": rows((1, "a.x", 1.0))}).collect()


def test_reduced_groups(spark):
    unit, half = [0.6, 0.8], [0.3, 0.4]
    groups = lambda *x: spark.createDataFrame(list(x), "part int, embedding_index long, frame_id int, embedding array<double>")
    good = groups((5, 0, 1, unit), (2, 1, 2, unit), (2, 0, 3, unit))
    assert {(r.frame_id, r.position) for r in vector.reduced(good, "part").collect()} == {(3, 0), (2, 1), (1, 2)}
    for bad in (groups((1, 0, 1, unit), (1, 2, 2, unit)), groups((1, 0, 1, unit), (1, 0, 2, unit)), groups((1, 0, 1, unit), (2, 0, 1, unit)), groups((1, 0, 1, half)), groups((1, 0, 1, unit), (2, 0, 2, [1.0])), groups((1, 0, 1, [float("nan"), 1.0]))):
        with pytest.raises(ValueError):
            vector.reduced(bad, "part")


def test_scores_of_videos_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "ASKED", 2)
    monkeypatch.setattr(vector, "ROWS", 3)
    rng = np.random.default_rng(4)
    q, x = rng.normal(0, 1, (7, 5)), rng.normal(0, 1, (40, 5))
    asked = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(q)], "query_id long, query array<double>, task int")
    corpus = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "frame_id long, video_id long, embedding array<double>")
    pairs = {(i, v) for i in range(7) for v in range(5) if (i + v) % 3}
    got = {(r.query_id, r.frame_id): (r.score, r.task, r.video_id) for r in vector.scored_within(asked, corpus, spark.createDataFrame(list(pairs), "query_id long, video_id long")).collect()}
    assert got.keys() == {(i, f) for i, v in pairs for f in range(40) if f % 4 == v}
    assert all(abs(s - q[i] @ x[f]) < 1e-6 and t == i % 2 and v == f % 4 for (i, f), (s, t, v) in got.items())


def test_steps_carry_no_session_whose_last_hint_was_heard(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, i // 3, 1000 * i, [1.0, float(i)]) for i in range(9)], "frame_id long, video_id long, timestamp_ms long, embedding array<double>")
    hints = spark.createDataFrame([(0, [1.0, 1.0], 0, 0), (1, [1.0, 0.5], 0, 1), (10, [1.0, 2.0], 1, 0)], "query_id long, query array<double>, task long, event int")
    carried, written = [], progressive.shared.written

    def seen(df, name):
        out = written(df, name)
        if name == "evidence":
            carried.append(sorted(r.task for r in out.select("task").distinct().collect()))
        return out

    monkeypatch.setattr(progressive.shared, "written", seen)
    state = progressive.acquire(hints, corpus, progressive.Budget(everywhere=4, within=2, kept=2, pool=2))
    assert carried == [[0, 1], [0]]
    assert {r.task for r in state.pool.collect()} == {r.task for r in state.evaluated.collect()} == {r.task for r in state.found.collect()} == {0, 1}


def test_all_hints_are_searched_for_at_once(spark, monkeypatch):
    """One search of the whole corpus serves all steps, and one that is equal in two videos is made up for as before."""
    corpus = spark.createDataFrame([(i, i // 3, 1000 * i, [1.0, float(i % 5)]) for i in range(12)], "frame_id long, video_id long, timestamp_ms long, embedding array<double>")
    hints = [(10 * t + e, [1.0, 0.5 * e], t, e) for t in range(2) for e in range(3)]
    searches = []
    monkeypatch.setattr(progressive.vector, "knn_join", lambda *a, f=vector.knn_join, **b: (searches.append(1), f(*a, **b))[1])
    budget = progressive.Budget(everywhere=4, within=3, kept=2, backfill_videos=1, backfill_hints=1, pool=2, least=1.5)
    state = progressive.acquire(spark.createDataFrame(hints, "query_id long, query array<double>, task long, event int"), corpus, budget)
    want = _plain_states(hints, [(r.frame_id, r.video_id, r.timestamp_ms, r.embedding) for r in corpus.collect()], budget)
    assert len(searches) == 1
    assert {(r.task, r.event, r.video_id) for r in state.evaluated.collect()} == {(t, *p) for t, s in want.items() for p in s[0]}
    assert {(r.task, r.event, r.video_id, r.frame_id, r.score) for r in state.found.collect()} == {(t, e, v, f, -s) for t, x in want.items() for (e, v), rows in x[1].items() for s, _, f in rows}


def test_scores_of_videos_take_no_group_of_python_each(spark, monkeypatch):
    """Blocks of a partition are one run; the best of a query and video come with ties by the columns given."""
    monkeypatch.setattr(vector, "ROWS", 4)
    corpus = spark.createDataFrame([(i, i % 3, 100 - i, [1.0, float(i % 2)]) for i in range(30)], "frame_id long, video_id long, timestamp_ms long, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)], i) for i in range(4)], "query_id long, query array<double>, task int")
    pairs = asked.select("query_id").crossJoin(spark.range(3).withColumnRenamed("id", "video_id"))
    every = vector.scored_within(asked, corpus, pairs)
    assert "CoGroup" not in every._jdf.queryExecution().toString() and every.count() == 4 * 30
    best = fusion.top_per(vector.scored_within(asked, corpus, pairs, most=2, ties=("timestamp_ms",)), ["query_id", "video_id"], [F.desc("score"), F.col("timestamp_ms")], 2)
    whole = fusion.top_per(every, ["query_id", "video_id"], [F.desc("score"), F.col("timestamp_ms")], 2)
    rows = lambda df: sorted((r.query_id, r.video_id, r.frame_id, r.score, r.task) for r in df.collect())
    assert rows(best) == rows(whole)


def test_clusters_of_groups_against_one_at_a_time():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = rng.integers(0, 12, rng.integers(1, 8))
        parts = [np.sort(rng.integers(-50, 200, n)) for n in sizes]
        got = sequences.clusters_of_groups(np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]), 20, 45)
        assert got.tolist() == [c for p in parts for c in sequences.bounded_clusters(p, 20, 45).tolist()]


def test_keys_are_compared_without_making_them_whole(monkeypatch):
    pool = ["a", "A", "ß", "ss", " ", ".", ",", "É", "é", "x", "\u00a0", "ﬁ", "Σ", "ς"]
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice(pool) for _ in range(rng.randrange(6))) for _ in range(2))
        b = a + b if rng.random() < 0.4 else b
        assert sessions._same_key(a, b) == (sessions._key(a) == sessions._key(b)), (a, b)
        spaced = a + "\t\n " + b + "\x1f\u2003"
        assert " ".join(unicodedata.normalize("NFC", spaced).split()) == re.sub(r"\s+", " ", unicodedata.normalize("NFC", spaced)).strip()
    seen = []
    monkeypatch.setattr(sessions, "_key", lambda t, f=sessions._key: (seen.append(len(t)), f(t))[1])
    assert sessions.step(1, ["u"], "word " * 1000 + "end", "word " * 1000 + "end more")[3] == "APPEND"
    assert sessions.step(1, ["u"], "one " * 1000, "two " * 1000)[3] == "REPLACEMENT"
    assert sum(seen) < 20


def test_a_search_in_whole_blocks_gives_ranks(spark, monkeypatch):
    """With the corpus in one part no order is made anew; queries of one id still share their ranks."""
    monkeypatch.setattr(vector, "SHIPPED", 8)
    rng = np.random.default_rng(9)
    q, x = rng.integers(-3, 4, (100, 3)).astype(float), rng.integers(-3, 4, (60, 3)).astype(float)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "frame_id long, embedding array<double>")
    asked = lambda ids: spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, q)], "query_id long, query array<double>")
    got = vector.knn_join(asked(range(100)), corpus, 7)
    assert "Window" not in got._jdf.queryExecution().toString() and got.schema["rank"].dataType.simpleString() == "int"
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :7]
    rows = {(r.query_id, r["rank"]): r.frame_id for r in got.collect()}
    assert rows == {(i, j + 1): f for i, fs in enumerate(want.tolist()) for j, f in enumerate(fs)}
    twice = vector.knn_join(asked(np.arange(100) // 2), corpus, 7).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("r")).collect()
    assert len(twice) == 50 and all(r.n == r.r == 7 for r in twice)
