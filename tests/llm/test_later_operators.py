"""Quality, hard negatives and periodic runs against brute force and held-out rows, and what was wrong in earlier operators."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from reelspark.llm import common, hard_negatives, periodic_runs, quality, queries, topk_search
from reelspark.llm.kernels import Words
from reelspark.llm.substring_dedup import substring_dedup

SF = "/root/testdata/sf0.01"
CLASHING = "doc_id long, text string, label int, score double, n_runs long, x string, r int"


def _brute_runs(w, least=6, times=4):
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                s = w[i : i + length]
                if not any(all(s[x] == s[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic_text(rng):
    letters, w = rng.choice(["ab", "abc", "a", "abcdefgh"]), []
    for _ in range(rng.randrange(0, 7)):
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 7))]
        w += (unit * rng.choice([1, 1, 2, 4, 5, 9]))[: rng.randrange(1, 60)]
    return w


def test_runs_of_many_texts_at_once():
    rng, found = random.Random(1), 0
    for _ in range(300):
        texts = [_periodic_text(rng) for _ in range(rng.randrange(1, 6))]
        of, *runs = periodic_runs.runs(Words([" ".join(w).encode() for w in texts]))
        for d, w in enumerate(texts):
            got = [r for k, r in zip(of.tolist(), zip(*(x.tolist() for x in runs))) if k == d]
            assert got == _brute_runs(w), w
            found += len(got)
    assert found > 500


def test_splitting_keeps_runs_and_drops_rare_words():
    words = "x a b a b a b a b y a b c d e f".split()
    ids = np.unique(words, return_inverse=True)[1]
    at, seg = periodic_runs.split(ids, np.zeros(len(ids), int))
    assert at.tolist() == list(range(1, 9)) and len(set(seg.tolist())) == 1


def test_long_periodic_texts_are_quick():
    for w, run in ((["a"] * 300_000, (0, 300_000, 1)), ([str(i % 7777) for i in range(300_000)], (0, 300_000, 7777))):
        of, *runs = periodic_runs.runs(Words([" ".join(w).encode()]))
        assert list(zip(*(x.tolist() for x in runs))) == [run]


def test_periodic_runs(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n\x0b", "one", "é é é é é é", "A a A a A a A a", "中 文 " * 5, " ".join(map(str, range(5000))), *[" ".join(_periodic_text(rng)) for _ in range(60)]]
    rows = [(i, t, 1, 0.5, 9, "x", 3) for i, t in enumerate(texts)] + [(None, "b " * 9, 1, 0.5, 9, "x", 3), (8, texts[8], 1, 0.5, 9, "x", 3)]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, CLASHING).repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        runs = _brute_runs(w)
        gone = {p for a, n, q in runs for p in range(a + q, a + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        r = by_id[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert [tuple(x) for x in r.runs] == runs and r.collapsed_text == (kept.decode() if runs else None)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
    assert periodic_runs.periodic_runs(spark.createDataFrame([], CLASHING)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame([], CLASHING), times=2)


def test_planted_runs(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(300)] + [(None, "a b"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): r.new for r in df.withColumn("new", periodic_runs.with_planted_runs(df.text, df.doc_id)).collect()}
    changed = 0
    for i, given in rows:
        t, w = given, (given or "").split()
        h, n = (zlib.crc32(str(i).encode()), len(w)) if i is not None else (1, 0)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t, changed = " ".join(w[j] if j < a else w[a + (j - a) % p] for j in range(n)), changed + 1
        assert got[i, given] == t
    assert changed > 10


def _negatives(rows, anchors, low=80, high=100, k=5):
    """By brute force, of (id, label, vector) rows."""
    out = []
    for a, label, v in rows:
        if a not in anchors:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, y)), i, own) for i, own, y in rows if i != a and len(y) == len(v))
        for s, p, own in [r for r in scored if r[2] == label][:k]:
            near = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block, cluster, step, spread", [(4096, 256, 512, 30), (40, 3, 16, 30), (25, 4, 8, 2000)])
def test_hard_negatives(spark, monkeypatch, block, cluster, step, spread):
    for name, value in (("BLOCK", block), ("CLUSTER", cluster), ("STEP", step)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (6, 8))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 6] + rng.integers(-spread, spread + 1, 8)).tolist()) for i in range(400)]
    rows += [(400 + i, i % 2, rows[7][2]) for i in range(60)]  # copies, ties
    rows += [(500, 9, [5] * 8), (501, 1, [0] * 8), (502, 1, [1, 2, 3]), (503, 2, [1, 2, 3]), (504, 1, [3, 2, 1]), (505, 3, [10**9] * 8)]
    more = [(506, None, [1] * 8), (507, 1, None), (None, 1, [1] * 8), (508, 1, []), (20, 7, [1] * 8)]
    df = spark.createDataFrame(rows + more + rows[:9], "vec_id long, label int, v array<long>").repartition(4)
    anchors = {i for i, *_ in rows if i % 10 == 0} | {501, 502, 505}
    asked = spark.createDataFrame([(i,) for i in [*anchors, 9999, 506]] + [(None,), (10,)], "vec_id long")
    got = hard_negatives.hard_negatives(df, asked)
    assert sorted(tuple(r) for r in got.collect()) == _negatives(rows, anchors)
    assert hard_negatives.hard_negatives(df.limit(0), asked).count() == 0 == hard_negatives.hard_negatives(df, asked.limit(0)).count()


def test_lists_end_early_among_clusters():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 5, (500, 16)) + c for c in np.eye(16)[:8] * 200]).astype(np.int64)
    table = lambda at: pa.table({"vec_id": pa.array(at), "label": pa.array(at % 2), "v": pa.array(list(x[at]))})
    page = hard_negatives.List(table(np.arange(20)), table(np.arange(4000)))
    for i in range(20):
        best = []

        def take(ids, labels, scores):
            best[:] = hard_negatives._first(best, ids, scores, 5)

        page.walk(i, lambda: -best[-1][0] if len(best) == 5 else -np.inf, take)
        truth = x @ x[i]
        assert best == sorted((-int(s), j) for j, s in enumerate(truth))[:5]
    assert page.evaluated < 20 * 4000 / 3


def test_statistics_say_what_they_are_named():
    good, bad, empty = quality.statistics([b"The cat sat on the mat. It was happy there.", b"buy buy buy buy now!!! $$$ ***", b""]) / quality.SCALE
    name = {n: i for i, n in enumerate(quality.STATISTICS)}
    assert bad[name["repeated_word"]] > good[name["repeated_word"]] and bad[name["marks"]] > good[name["marks"]]
    assert bad[name["doubled_marks"]] > good[name["doubled_marks"]] and empty[name["words"]] == 0
    together = quality.statistics([b"a b", "É é — 中文。".encode(), b"", b"x\n\nx\ny"])
    apart = np.concatenate([quality.statistics([t]) for t in (b"a b", "É é — 中文。".encode(), b"", b"x\n\nx\ny")])
    assert (together == apart).all()


def test_held_out_quality(spark):
    docs, labels = (common.read(spark, SF, t) for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.queries()["op11_quality"](spark, SF).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([g.predicted == q for g, q in held]) > 0.97
    # labels of held-out rows teach nothing
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality(docs, turned).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_quality_of_odd_rows(spark):
    texts = [None, "", " \n", "x" * 200_000, "one", "!!! ???", "中文。" * 50, "a b " * 30_000]
    docs = spark.createDataFrame([(i, t, 1, 0.5, 1, "y", 2) for i, t in enumerate(texts)] + [(None, "a", 1, 0.5, 1, "y", 2), (4, "one", 1, 0.5, 1, "y", 2)], CLASHING)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0), (5, 7), (0, 1)], "doc_id long, quality int")
    got = quality.quality(docs, odd).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    two = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(1, 1)], "doc_id long, quality int")
    got = quality.quality(docs, two).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 4}) == 1
    assert quality.quality(docs.limit(0), two).count() == 0


def test_model_is_a_shrunk_discriminant():
    rng = np.random.default_rng(5)
    size = len(quality.STATISTICS)
    x = {1: rng.normal(0, 300, (400, size)).round(), 0: rng.normal(200, 900, (40, size)).round()}
    model = quality.densities({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    for c, made in ((1, model.good), (0, model.bad)):
        cov = made.factor @ made.factor.T
        at = x[c][:5] / model.unit - made.mean
        want = -0.5 * np.einsum("ij,jk,ik->i", at, np.linalg.inv(cov), at) - 0.5 * np.linalg.slogdet(cov)[1]
        assert np.allclose(made.log_density(x[c][:5] / model.unit), want)
    own = np.cov((x[0] / model.unit).T)
    cov = model.bad.factor @ model.bad.factor.T
    off = ~np.eye(size, dtype=bool)
    assert np.abs(cov[off]).sum() < np.abs(own[off]).sum()


def test_far_pivots_lose_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 512)
    rng = np.random.default_rng(6)
    x = rng.integers(-400, 400, (3000, 64))
    order = sorted(range(3000), key=lambda i: i)
    from pyspark.sql import functions as F

    ids = [r.i for r in spark.range(3000).select(F.col("id").alias("i")).orderBy(F.xxhash64("i"), "i").limit(4).collect()]
    for i in ids:
        x[i, 5] = 30_000_001 + i
    df = spark.createDataFrame([(i, x[i].tolist()) for i in order], "vec_id long, v array<long>").repartition(4)
    got = {}
    for r in topk_search.topk_inner_product(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 3000, 50):
        s = x @ x[q]
        want = [(n + 1, i, int(s[i])) for n, i in enumerate([i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5])]
        assert sorted(got[q]) == want


def test_texts_of_one_id_keep_their_own_words(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(100)) for p in "xyz")
    rows = [(1, a), (2, f"{a} {c}"), (2, b), (2, f"{a} {c}"), (3, f"{b} {c}"), (None, c)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    text = lambda t: (t, hashlib.sha256(t.encode()).hexdigest())
    want = [(None, 0, *text(c)), (1, 0, *text(a)), (2, 200, *text("")), (2, 200, *text("")), (2, 0, *text(b)), (3, 200, *text(""))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    assert sorted(((r.doc_id, r.n_removed, "", r.kept_sha256) for r in got.collect()), key=key) == sorted(((i, n, "", h) for i, n, _, h in want), key=key)


def test_the_session_keeps_its_settings(spark):
    before = spark.conf.get(common.BATCH)
    common.table(spark.range(3), "x")
    assert spark.conf.get(common.BATCH) == before
