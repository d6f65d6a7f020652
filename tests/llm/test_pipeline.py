"""The pipeline, stage by stage, each against a brute-force version on its own input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelspark.llm import common, mixing, packing
from reelspark.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.read(spark, SF, "documents")
    extra = [(-5, None, "en", "src0", 0), (-6, "!!! 12 --", "en", "src1", 9), (-7, "The and attion to thanedble the, anea and the rest of it.", None, None, 57)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(common.table(f(spark, out[-1], SF), "stage"))
    return [x.toPandas() for x in out]


def test_columns(stages):
    for x in stages[:-1]:
        assert list(x.columns) == corpus_pipeline.COLUMNS
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_rejected_documents_go(stages):
    before, after = set(stages[0].doc_id), set(stages[1].doc_id)
    assert {-5, -6} == before - after


def test_one_of_each_near_duplicate_group_stays(stages):
    d = stages[1]
    sets = {}
    for i, t in zip(d.doc_id, d.text):
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    group = {i: i for i in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    assert sorted(stages[2].doc_id) == sorted({top(i) for i in ids})
    text = dict(zip(d.doc_id, d.text))
    assert all(text[i] == t for i, t in zip(stages[2].doc_id, stages[2].text))


def test_repeated_passages_go(stages):
    d, seen, want = stages[2].sort_values("doc_id"), {}, {}
    for i, t in zip(d.doc_id, d.text):
        w, gone = t.encode().split(), set()
        for j in range(len(w) - 49):
            if seen.setdefault(tuple(w[j : j + 50]), i) < i:
                gone |= set(range(j, j + 50))
        if kept := [x for j, x in enumerate(w) if j not in gone]:
            want[i] = kept
    got = {i: t.encode().split() for i, t in zip(stages[3].doc_id, stages[3].text)}
    assert got == want
    assert all(n == len(t) for n, t in zip(stages[3].n_chars, stages[3].text))


def test_mix_takes_what_the_operator_says(spark, stages):
    d = spark.createDataFrame(stages[3])
    taken = {r.doc_id: r.copies for r in mixing.mix(d).collect() if r.copies}
    assert Counter(stages[4].doc_id) == taken and set(taken.values()) <= {1, 2}


def test_packing_holds_every_copy(stages):
    encode = packing.encoder(vocabulary()).encode
    want = Counter((i, len(encode(t)) // 4 + 1) for i, t in zip(stages[4].doc_id, stages[4].text))
    got = stages[5].groupby("sequence_id").length.sum()
    assert got.max() <= 2048 and stages[5].length.sum() == sum(n * c for (_, n), c in want.items())
    assert len(got) <= -(-int(stages[5].length.sum()) // 2048) + 2
    first = stages[5][stages[5].piece == 0]
    assert Counter(first.doc_id) == Counter(stages[4].doc_id)
    assert np.array_equal(np.sort(stages[5].groupby("sequence_id").offset.min().unique()), [0])


def test_documents_that_share_an_id_are_different_ones(spark):
    word = iter(range(10**6))
    text = lambda n: " ".join(f"w{next(word)}" for _ in range(n))
    a, b, c, d, shared, blank = text(30), text(30), text(30), text(30), text(60), " "
    e, f = f"{shared} {text(20)}", f"{text(20)} {shared} {text(20)}"
    given = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, e), (7, f), (8, d), (9, blank), (9, blank)]
    rows = [(i, t, "en", "src0", len(t)) for i, t in given]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = common.table(corpus_pipeline.near_duplicates(spark, docs, SF), "kept")
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(None, a), (None, b), (7, c), (7, d), (7, e), (7, f), (9, blank), (9, blank)])

    cut = common.table(corpus_pipeline.repeated_passages(spark, kept, SF), "cut")
    texts = Counter((r.doc_id, r.text) for r in cut.collect())
    assert {(None, a), (None, b), (7, c), (7, d)} <= set(texts)
    assert sum(shared in t for _, t in texts) == 1 and sum(i == 7 for i, _ in texts) == 4

    places = corpus_pipeline._unique(cut)
    taken = {r.doc_id: r.copies for r in mixing.mix(places).collect()}
    want = Counter((r._given, r.text) for r in places.collect() for _ in range(taken[r.doc_id]))
    mixed = corpus_pipeline.mix_sources(spark, cut, SF)
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == want


def test_empty_table(spark):
    docs = common.read(spark, SF, "documents").where("false")
    for name, f in corpus_pipeline.STAGES:
        docs = common.table(f(spark, docs, SF), "empty")
        assert docs.count() == 0
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS


def test_nulls_long_texts_and_clashing_columns(spark):
    docs = common.read(spark, SF, "documents")
    long = " ".join(f"w{i}" for i in range(60_000))
    said = " ".join(docs.where("lang = 'en'").limit(30).toPandas().text)
    given = [(None, None, None, None, None), (None, "", "en", None, 0), (-3, f"{said} {long}", None, None, None), (-2, f"{said} {long} x", "en", "src0", 5)]
    docs = docs.unionByName(spark.createDataFrame(given, docs.schema))
    for i, c in enumerate(("_id", "_given", "row", "copies", "kept_text", "component_id", "position", "c", "text_crc32", "accepted")):
        docs = docs.withColumn(c, F.lit(i))
    kept = []
    for name, f in corpus_pipeline.STAGES:
        docs = common.table(f(spark, docs, SF), "odd")
        kept.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    assert None not in kept[0] and {-3, -2} <= kept[0]
    assert -3 in kept[1] and -2 not in kept[1]
    assert -3 in kept[2]


def test_null_texts_stay_where_no_stage_takes_them(spark):
    rows = [(1, None, None, None, None), (2, None, "en", "a", 0), (3, " ", None, "a", 1), (4, "some words", "en", None, 10), (4, "some words", "en", None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = common.table(corpus_pipeline.near_duplicates(spark, docs, SF), "near")
    assert sorted(r.doc_id for r in near.collect()) == [1, 2, 3, 4]
    cut = common.table(corpus_pipeline.repeated_passages(spark, near, SF), "cut")
    assert sorted(r.doc_id for r in cut.collect()) == [1, 2, 3, 4]
    assert {r.doc_id for r in corpus_pipeline.pack(spark, cut, SF).collect()} == {1, 2, 3, 4}
