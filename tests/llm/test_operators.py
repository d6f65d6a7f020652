"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeated rows and
columns of clashing names; and on an empty table."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reelspark.llm import fingerprints as fp
from reelspark.llm import language_id, licenses, mixing, packing, sharding, topk_search
from reelspark.llm import ngram_jaccard as nj
from reelspark.llm.ngram_jaccard import ngram_jaccard
from reelspark.llm.queries import vocabulary
from reelspark.llm.substring_dedup import substring_dedup
from reelspark.llm.token_counts import Counter, token_counts

train = language_id.train
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c long, n long, key string, start int, score double, position long"
WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _edit(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def _rows():
    rng = random.Random(5)
    base, passage = _text(rng, 150), _text(rng, 70)
    texts = [None, "", " \t\n", "one", "Two words", "two  WORDS", "!!! ...", "0 1 2", base, base, base.upper(), f" {base}"]
    texts += [_edit(rng, base, rng.choice([1, 2, 3, 5, 8])) for _ in range(60)]
    texts += [f"{_text(rng, rng.randrange(40))} {passage} {_text(rng, rng.randrange(40))}" for _ in range(12)]
    texts += [_text(rng, rng.randrange(1, 9)) for _ in range(20)] + [_text(rng, 6000), "x" * 30_000, passage, _text(rng, 49), _text(rng, 50)]
    texts += ["été Ä ß Σίσυφος 中文 don't <|endoftext|> x", "Released under the MIT License.", f"{_text(rng, 60)}\nLicensed under the Apache License, Version 2.0."]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(order[i] * 3, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", "é", None])) for i, t in enumerate(texts)]
    rows.append(rows[8])
    rows.append((None, "a row without an id", "en", "b"))
    return [(i, t, la, s, len(t or ""), 7, 8, "k", 9, 0.5, 11) for i, t, la, s in rows]


ROWS = _rows()
IDS = [r[0] for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def test_ngram_jaccard(docs, none):
    sets = []
    for r in ROWS:
        w = _words(r[1], True)
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    group = list(range(len(ROWS)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(ROWS)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                group[top(a)] = top(b)
    low = {}
    for i in range(len(ROWS)):
        k = top(i)
        low[k] = min(low.get(k, 1 << 60), -1 if IDS[i] is None else IDS[i])
    want = sorted((-1 if IDS[i] is None else IDS[i], len(sets[i]), low[top(i)]) for i in range(len(ROWS)))
    got = [tuple(-1 if v is None else v for v in r) for r in ngram_jaccard(docs, 4, 85).collect()]
    assert sorted(got) == want
    assert len({g for _, _, g in want}) < len(want) - 30
    assert ngram_jaccard(none, 4, 85).count() == 0


def _near(texts, k, percent):
    """Each text's component by brute force: the smallest index that links reach."""
    sets = []
    for t in texts:
        w = _words(t, True)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(texts)))
    top = lambda x: x if group[x] == x else top(group[x])
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("width, tile, followers", [(64, 1024, 128), (64, 3, 2), (3, 1024, 128)])
def test_near_copies_of_all_sizes(spark, monkeypatch, width, tile, followers):
    monkeypatch.setattr(nj, "TILE", tile)
    monkeypatch.setattr(nj, "FOLLOWERS", followers)
    rng = random.Random(11)
    hot = _text(rng, 12)
    texts = []
    for n in (30, 60, 200, 1200, 3000):
        base = _text(rng, n)
        for _ in range(7):
            base = _edit(rng, base, max(1, n // 60))  # a chain: the ends don't link, their neighbours do
            texts.append(base)
    texts += [f"{hot} {_text(rng, rng.randrange(3, 60))}" for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard(docs, 3, 80, width=width).collect()}
    want = _near(texts, 3, 80)
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(texts) - 15


def test_bit_sketches_bound_the_difference_and_fold():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1500).astype(np.uint64))
    b = np.unique(np.concatenate([a[100:], rng.integers(0, 2**63, 700).astype(np.uint64)]))
    x, y = nj._bits(a).view(np.uint64), nj._bits(b).view(np.uint64)
    assert len(x) * 64 == 2048 and len(y) * 64 == 4096
    folded = y[: len(x)] ^ y[len(x) :]
    parity = np.bincount((b % np.uint64(2048)).astype(int), minlength=2048) & 1
    assert np.array_equal(folded, np.packbits(parity.astype(np.uint8)).view(np.uint64))
    assert 0 < np.bitwise_count(x ^ folded).sum() <= len(np.setxor1d(a, b))


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(2)
    sets, root = [], []
    for i in range(40):
        base = rng.integers(0, 2**63, int(rng.choice([40, 900, 1100, 2100]))).astype(np.uint64)
        for _ in range(3):
            new = base.copy()
            new[: len(new) // 20] = rng.integers(0, 2**63, len(new) // 20)
            sets.append(np.unique(new))
            root.append(len(root))
    n = np.array([len(u) for u in sets])
    step = np.floor(np.log(n) / (1.000001 * np.log(100 / 80))).astype(np.int64)
    want = {(a, b) for a in range(120) for b in range(a) if 180 * len(np.setxor1d(sets[a], sets[b])) <= 20 * (n[a] + n[b])}
    found = set()
    for at in np.unique(step).tolist():
        rows = [i for i in range(120) if step[i] in (at, at + 1)]
        columns = {"key": [1] * len(rows), "step": [at] * len(rows), "i": [0] * len(rows), "j": [0] * len(rows), "b": [0] * len(rows), "low": [bool(step[i] == at) for i in rows]}
        columns |= {"c": rows, "root": [root[i] for i in rows], "n": [int(n[i]) for i in rows], "bits": [nj._bits(sets[i]).tolist() for i in rows]}
        batches = pa.table(columns).to_batches(max_chunksize=7)
        for out in nj._tile_pairs(80)(iter(batches)):
            found |= {(max(p), min(p)) for p in zip(out["c"].to_pylist(), out["l"].to_pylist())}
    assert len(want) > 100 and want <= found and len(found) < 2 * len(want)


def test_sharding(docs, none):
    got = sharding.shard(docs, 5).collect()
    size = lambda t: len((t or "").encode()) + 1
    told = lambda i, t: (-1 if i is None else i, size(t), zlib.crc32((t or "").encode()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted(told(r[0], r[1]) for r in ROWS)
    total = []
    for s in range(5):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        total.append(sum(r.size for r in own))
    # slots move whole: the shards are as near as the fullest slots allow
    load = {}
    for r in got:
        load[r.slot_no] = load.get(r.slot_no, 0) + r.size
    assert sum(total) == sum(size(r[1]) for r in ROWS) and max(total) - min(total) <= max(load.values())
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.slot_no, set()).add(r.shard)
    assert all(len(v) == 1 for v in by_slot.values())
    even = [(i, "x" * (i % 90)) for i in range(5000)]
    total = [0] * 16
    for r in sharding.shard(docs.sparkSession.createDataFrame(even, "doc_id long, text string"), 16).collect():
        total[r.shard] += r.size
    assert max(total) - min(total) <= 3
    assert sharding.shard(none, 5).count() == 0


def test_rebalancing_edits_the_map():
    rng = random.Random(1)
    loads = {s: rng.randrange(1, 2000) for s in range(4096)}
    first = sharding.rebalanced(loads, {s: s % 16 for s in loads}, 16)
    total = [sum(loads[s] for s in loads if first[s] == k) for k in range(16)]
    assert max(total) - min(total) <= 2
    grown = sharding.rebalanced(loads, first, 17)
    assert sum(first[s] != grown[s] for s in loads) < 0.1 * len(loads)
    total = [sum(loads[s] for s in loads if grown[s] == k) for k in range(17)]
    assert max(total) - min(total) <= 2


def test_mixing(docs, none):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS]
    by = {}
    for r, n in zip(ROWS, sizes):
        by[r[3]] = by.get(r[3], 0) + n
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in by if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {}, set(by)
    while True:
        rest = 1.5 * sum(by.values()) - sum(target.values())
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > 2 * by[s]]
        if not over:
            break
        target |= {s: 2.0 * by[s] for s in over}
        left -= set(over)
    target |= {s: rest * weight[s] / total for s in left}
    got = mixing.mix(docs).collect()
    assert sorted(r.size for r in got) == sorted(sizes)
    seen = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        seen.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted(seen) == sorted({(by[s], round(target[s], 6)) for s in by})
    assert all(abs(sum(v) - t) <= max(sizes) for (_, t), v in seen.items())
    again = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    got = packing.best_fit_packing(docs, vocabulary()).collect()
    want = []
    for r in ROWS:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want += [(r[0] or -1, i, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for i, a in enumerate(range(0, len(ids), 2048))]
    key = lambda r: (r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.best_fit_packing(none, vocabulary()).count() == 0


def test_best_fit_keeps_every_item():
    sizes = np.array([5, 5, 3, 8, 2, 10, 1, 7])
    bins = packing.best_fit(sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(8))
    assert all(sizes[b].sum() <= 10 for b in bins) and len(bins) == 5


def test_topk(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[200:] = x[:100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (450, [float("nan")] * 8), (500, [None] + [0.5] * 7), (550, [float("inf")] * 8), (600, [1.0, 2.0])]
    v = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = topk_search.topk_inner_product(v, v.where("vec_id % 50 = 0"), 5).collect()
    q = np.floor(256 * x.astype(float)).astype(int)
    want = []
    for i in range(0, 300, 50):
        s = q @ q[i]
        want += [(i, n + 1, j, -s_) for n, (s_, j) in enumerate(sorted((-int(s[j]), j) for j in range(300) if j != i)[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk_search.topk_inner_product(v.where("false"), v.where("false"), 5).count() == 0


def test_topk_of_repeated_ids_and_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = np.round(centres[np.arange(600) % 20] * 3 + rng.normal(scale=0.05, size=(600, 16)), 3)
    ids = [i % 550 for i in range(600)]  # fifty ids twice
    rows = [(i, v) for i, v in zip(ids, x.tolist())] + [(None, [1.0] * 16)]
    v = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = topk_search.topk_inner_product(v, v.where("vec_id % 50 = 0"), 5).collect()
    q = np.floor(256 * x).astype(int)
    want = []
    for i in range(0, 550, 50):
        best = {}
        for a in np.flatnonzero(np.array(ids) == i):
            for j, s in zip(ids, (q @ q[a]).tolist()):
                if j != i:
                    best[j] = max(best.get(j, s), s)
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted((-s, j) for j, s in best.items())[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_bounds_save_evaluations():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 8)) * 1000
    x = np.floor(centres[rng.integers(0, 16, 2000)] + rng.normal(scale=20, size=(2000, 8)))
    p = x[:32]
    far = np.sqrt(((x[:, None] - p[None]) ** 2).sum(2))
    table = lambda rows: pa.table({"vec_id": rows, "v": x[rows].astype(int).tolist(), "d": far[rows].tolist(), "n2": (x[rows] ** 2).sum(1), "floor": pa.nulls(len(rows), pa.int64())})
    queries, everything = np.arange(0, 2000, 100), np.arange(2000)
    found, evaluated = topk_search.search(table(queries), table(everything), 8, 5)
    want = []
    for i in queries.tolist():
        s = (x @ x[i]).astype(int)
        want += [(i, j, -s_) for s_, j in sorted((-int(s[j]), j) for j in range(2000) if j != i)[:5]]
    assert sorted(found) == sorted(want) and evaluated < 0.5 * len(queries) * 2000


def test_language_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 20)
    rows = [(None, f"the cat sat on mat number {i}", "en") for i in range(300)] + [(i, f"der hund und die katze nummer {i}", "de") for i in range(300)]
    seen = []
    monkeypatch.setattr(language_id, "train", lambda languages, rows, seed=3: seen.append((languages, len(rows))) or train(languages, rows, seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = language_id.language_id(docs).collect()
    assert seen == [(["de", "en"], 40)] and len(got) == 600
    assert sum(r.lang_pred == ("en" if r.doc_id is None else "de") for r in got) > 590


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_id.language_id(docs).collect() if r.held_out and truth[r.doc_id]]
    assert len(got) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.98 * len(got)


def test_language_id(docs, none, spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    en, de = ["the cat sat on this mat with that hat", "where there is a way"], ["der hund und die katze sind nicht hier", "das ist ein haus und eine maus"]
    rows = [(i, " ".join(random.Random(i).choices((en if i % 2 else de)[i // 2 % 2].split(), k=12)), "en" if i % 2 else "de") for i in range(200)] + [(900, None, "en"), (901, "123 !", "en"), (902, "das ist nicht die katze", None)]
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].held_out == held(i) for i in got)
    assert all(got[i].lang_pred == rows[i][2] for i in range(200))
    assert got[900].lang_pred == got[901].lang_pred == "und" and not got[901].accepted and got[901].score == 0
    assert got[902].lang_pred == "de"
    mixed = language_id.language_id(docs, keep=("doc_id", "text", "score")).collect()
    assert len(mixed) == len(ROWS) and all(0 <= r.score <= 1 for r in mixed) and mixed[0].row.score == 0.5
    assert language_id.language_id(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.language_id(unlabelled).first().lang_pred == "und"


def test_licenses(spark, none):
    from pyspark.sql import functions as F

    rows = [
        (1, "p/LICENSE", "Released under the MIT License."),
        (2, "p/src/a.txt", "some words here"),
        (3, "p/src/lib/b.txt", "more words in a text\nthat goes on for long enough to be no notice\nLicensed under the Apache License, Version 2.0."),
        (4, "q/c.txt", "nothing"),
        (5, "q/d.txt", None),
        (6, None, "This work is licensed under the GNU General Public License, version 3."),
        (7, "p/src/lib/e.txt", ""),
        (2, "p/src/a.txt", "some words here"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, file string, text string").withColumn("path", F.lit("clash"))
    got = {(r.doc_id, r.licence, r.origin, r.licence_dir) for r in licenses.license_scan(df, F.col("file")).collect()}
    assert got == {(1, "MIT", "own", None), (2, "MIT", "inherited", "p"), (3, "Apache-2.0", "own", None), (4, "GPL-3.0", "inherited", ""), (5, "GPL-3.0", "inherited", ""), (6, "GPL-3.0", "own", None), (7, "MIT", "inherited", "p")}
    assert licenses.license_scan(none, F.col("source")).count() == 0


def test_real_licence_headers(spark):
    from pyspark.sql import functions as F

    apache = """# Copyright 2020 The Authors\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     https://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an "AS IS" BASIS"""
    mit = """MIT License\n\nCopyright (c) 2019 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."""
    gnu = """// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU %sGeneral Public License as published by\n// the Free Software Foundation, either version %d of the License, or\n// (at your option) any later version."""
    bsd = """Copyright (c) 2018, Some One\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"""
    three = """3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."""
    long = "as was said before in this file the whole of it is Released under the MIT License. and more words"
    cases = [(apache, "Apache-2.0"), (mit, "MIT"), (gnu % ("", 3), "GPL-3.0"), (gnu % ("", 2), "GPL-2.0"), (gnu % ("Lesser ", 3), "LGPL-3.0")]
    cases += [(bsd, "BSD-2-Clause"), (bsd + three, "BSD-3-Clause"), ("x = 1 # SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), (long, "MIT")]
    zlib_ = """  Permission is granted to anyone to use this software for any purpose,\n  including commercial applications, and to alter it and redistribute it\n  freely, subject to the following restrictions:\n\n  1. The origin of this software must not be misrepresented; you must not\n     claim that you wrote the original software.\n  2. Altered source versions must be plainly marked as such, and must not be\n     misrepresented as being the original software.\n  3. This notice may not be removed or altered from any source distribution."""
    cases += [("you need a licence to drive a car", None), ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), ("SPDX-License-Identifier: EUPL-1.2", None)]
    cases += [("This work is not licensed under the MIT License.", None), ("It was never released under the MIT License.\n\nLicensed under CC BY-SA 4.0.", "CC-BY-SA-4.0")]
    cases += [(zlib_, "Zlib"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0")]
    cases += [("Licensed under the Foo License, version 7.", None), (gnu % ("Affero ", 3), "AGPL-3.0")]
    df = spark.createDataFrame([(i, f"d{i}/x.c", t) for i, (t, _) in enumerate(cases)], "doc_id long, path string, text string")
    got = {r.doc_id: r.licence for r in licenses.license_scan(df, F.col("path")).collect()}
    assert got == {i: x for i, (_, x) in enumerate(cases)}


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    got = token_counts(docs, vocabulary()).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts(none, vocabulary()).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_of_odd_texts(name):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary(name)), Counter(vocabulary(name))
    rng = random.Random(3)
    letters = [chr(i) for i in range(0x250)] + list("ΣσςİıſǅßÅé 中한\U0001f600‍'’ \x85\x1c<|>") + ["<|endoftext|>", "'s", "  ", "'re"]
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


def test_fingerprints(docs, none):
    got = fp.fingerprints(docs).collect()
    rows = sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0]))
    texts = [r[1] or "" for r in rows]
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, r in enumerate(rows):
        if sum(x[0] == r[0] for x in rows) > 1:
            continue
        following = texts[(i + 1) % len(texts)]
        new = fp.edited(texts[i], following)
        (g,) = by[r[0]]
        assert g.n_chars == len(texts[i]) and g.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert g.fingerprint == fp.shown(fp.digest(texts[i].encode())) and g.edited_fingerprint == fp.shown(fp.digest(new.encode()))
        assert g.near_edited == fp.likeness(fp.digest(texts[i].encode()), fp.digest(new.encode()))
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        if len(texts[i]) > 3000 and len(set(texts[i])) > 5:
            assert g.near_edited > 0.4
    assert fp.fingerprints(none).count() == 0


def _plain_digest(text):
    """The filters of a text, window by window."""
    data, n = text.encode(), max(0, len(text.encode()) - 63)
    if not n:
        hashes = [int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")] if data else []
    else:
        ranks = []
        for i in range(n):
            counts = np.bincount(np.frombuffer(data[i : i + 64], np.uint8) & 31, minlength=32)
            p = counts[counts > 0] / 64
            e = float(-(p * np.log2(p)).sum())
            ranks.append((1 << 21) if e < 1 - 1e-9 else (1 << 20) - min(1 << 20, int(abs(np.float32(e) - 4.0) * 65536)))
        near = min(64, n)
        score = np.zeros(n, int)
        for i in range(n - near + 1):
            score[min(range(i, i + near), key=lambda j: (ranks[j], j))] += 1
        chosen = [i for i in range(n) if score[i] >= min(16, n - near + 1) and ranks[i] < 1 << 21]
        power, hashes = 0x9E3779B97F4A7C15, []
        for i in chosen:
            h, scale = 0, 1
            for b in data[i : i + 64]:
                h, scale = (h + (b + 1) * scale) % 2**64, scale * power % 2**64
            h = (h + 10 * power) % 2**64
            h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
            hashes.append(h ^ (h >> 31))
    own = list(dict.fromkeys(hashes))
    return [{(h >> (11 * i)) % 2048 for h in own[a : a + 160] for i in range(5)} for a in range(0, len(own), 160)]


def _plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    total = weight = 0
    for x in a:
        best = 0.0
        for y in b:
            chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
            cut = chance + 0.1 * (most - chance)
            best = max(best, min(1.0, max(0.0, (len(x & y) - cut) / max(most - cut, 1e-9))))
        total, weight = total + best * len(x), weight + len(x)
    return total / weight


def test_fingerprints_against_a_plain_version(spark):
    rng = random.Random(8)
    base = _text(rng, 500)
    texts = ["", "short", "x" * 200, base, _edit(rng, base, 6), _text(rng, 60), "été Ä ß " + _text(rng, 120), _text(rng, 900)]
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    plain = [_plain_digest(t) for t in texts]
    for i, t in enumerate(texts):
        count, bits = got[i].fingerprint.split(":")
        bits = np.unpackbits(np.frombuffer(base64.b64decode(bits), np.uint8)).reshape(-1, 2048)
        assert int(count) == len(plain[i]) and [set(np.flatnonzero(x).tolist()) for x in bits] == plain[i]
        new = t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(got[i].near_edited - _plain_likeness(plain[i], _plain_digest(new))) < 1e-5
        assert abs(got[i].near_next - _plain_likeness(plain[i], plain[(i + 1) % len(texts)])) < 1e-5


def test_entropy_of_windows():
    data = np.frombuffer(("the quick brown fox jumps over the lazy dog " * 4).encode(), np.uint8)
    got = fp.entropies(data)
    for i in (0, 17, len(got) - 1):
        _, n = np.unique(data[i : i + fp.WINDOW] & 31, return_counts=True)
        p = n / fp.WINDOW
        assert abs(got[i] + (p * np.log2(p)).sum()) < 1e-4


def test_passages_in_many_contexts(spark):
    rng = random.Random(9)
    a, b, c = _text(rng, 30), _text(rng, 40), _text(rng, 55)
    parts = [a, b, c, f"{a} {b}", "tick " * 70, "tick " * 130]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.6 else _text(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    first = {}
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for i, t in enumerate(texts):
        w = t.split()
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed) == (len(w), int(gone.sum()))
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        if got[i].repeats is not None:
            spans = np.zeros(len(w), bool)
            for s in got[i].repeats:
                spans[s.start : s.end] = True
            assert np.array_equal(spans, gone)


def test_substring_dedup(docs, none):
    key = lambda r: -1 if r[0] is None else r[0]
    first = {}
    for r in sorted(ROWS, key=key):
        w = _words(r[1])
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), key(r))
    want = []
    for r in ROWS:
        w = _words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < key(r):
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((key(r), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    for r in got:
        if r.kept_text is not None:
            assert hashlib.sha256(b" ".join(r.kept_text.encode().split())).hexdigest() == r.kept_sha256
    assert sum(w[2] > 0 for w in want) > 10
    assert substring_dedup(none).count() == 0
