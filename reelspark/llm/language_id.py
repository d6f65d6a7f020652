"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams; letters are folded to lower case, and runs of other
ASCII characters count as one word end.  Embeddings and softmax are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows: at most PER_LANGUAGE rows of each language, those whose hashed ids are
smallest.  A fifth of the sample, thinned to FEW n-grams a text so that it holds hard cases, sets the softmax temperature
and the score below which a text is rejected.

As the average and the softmax's input are linear, prediction needs one row of scores for each bucket: a text's scores
are its bucket counts times that matrix, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from . import common
from .kernels import chunks, lists, sliced, utf8

BUCKETS, DIMENSIONS, NGRAMS = 1 << 13, 16, (2, 3, 4)
#: The bounds of the training sample: rows of each language, and rows in all, dealt to the languages in turn.
PER_LANGUAGE, SAMPLE = 300, 4000
#: Parts of a language that are ranked apart.
PARTS = 64
EPOCHS, RATE = 12, 2.0
#: N-grams of a calibration text.
FEW = 30
#: The share of the calibration texts, rightly predicted, that rejection may cost.
REJECTED = 0.002

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
UNKNOWN = "und"


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The buckets of each text's n-grams, one for each place."""
    for a, b in chunks(texts):
        data = _FOLD[np.frombuffer(b" ".join(texts[a:b]) + b" ", np.uint8)]
        keep = np.ones(len(data), bool)
        keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        place = np.cumsum(keep)  # kept characters up to each place
        bounds = np.append(0, place[ends - 1])
        data = data[keep]
        h, each = np.zeros(len(data), np.uint32), []
        for i in range(max(NGRAMS)):
            h = h * np.uint32(0x01000193) + np.append(data[i:], np.full(min(i, len(data)), 32, np.uint32))
            if i + 1 in NGRAMS:
                g = (h ^ np.uint32(i)) * np.uint32(0x9E3779B1)
                each.append((g >> np.uint32(32 - 13)).astype(np.int32))
        for p, q in zip(bounds[:-1], bounds[1:]):
            yield np.concatenate([g[p : max(p, q - n + 1)] for g, n in zip(each, NGRAMS)])


@dataclass(frozen=True)
class Model:
    """languages; scores (bucket by language, of embeddings times softmax weights), bias; temperature; the least score
    that is accepted."""

    languages: tuple[str, ...]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, text: str, buckets: np.ndarray) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if not self.languages or not len(buckets) or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        logits = np.bincount(buckets, minlength=BUCKETS) @ self.scores / len(buckets) + self.bias
        e = np.exp((logits - logits.max()) / self.temperature)
        best = int(logits.argmax())
        score = float(e[best] / e.sum())
        return self.languages[best], score, score >= self.least


def train(languages: list[str], rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3) -> Model:
    """From rows of (language, distinct buckets, their counts), in a fixed order."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = len(languages)
    emb, soft, bias = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, n)), np.zeros(n)
    at = {x: i for i, x in enumerate(languages)}
    data = [(at[lang], idx, cnt / cnt.sum()) for lang, idx, cnt in rows if len(idx)]
    fit, held = [x for i, x in enumerate(data) if i % 5], [x for i, x in enumerate(data) if not i % 5]
    fit, held = (fit, held) if fit else (data, data)
    soft = rng.normal(0, 0.1, (DIMENSIONS, n))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fit)):
            y, idx, w = fit[i]
            x = w @ emb[idx]
            z = x @ soft + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = soft @ g
            soft -= rate * np.outer(x, g)
            bias -= 0.1 * rate * g
            emb[idx] -= rate * np.outer(w, back) * 10
    scores = emb @ soft
    thin = [(y, idx, rng.multinomial(FEW, w) / FEW) for y, idx, w in held]
    logits = np.array([w @ scores[idx] + bias for _, idx, w in thin]).reshape(len(held), n)
    truth = np.array([y for y, _, _ in held], int)

    def log_p(t: float) -> np.ndarray:
        z = (logits - logits.max(1, keepdims=True)) / t
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0), key=lambda t: -log_p(t)[np.arange(len(truth)), truth].sum()) if len(held) else 1.0
    p = np.exp(log_p(temperature)) if len(held) else np.zeros((0, n))
    right = p[p.argmax(1) == truth].max(1) if len(held) else np.zeros(0)
    least = float(np.quantile(right, REJECTED)) if len(right) else 0.0
    return Model(tuple(languages), scores.astype(np.float32), bias.astype(np.float32), temperature, min(least, 0.5))


def held_out(id_column) -> F.Column:
    """Whether a row takes no part in learning: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "utf-8")) % 4 == 2


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    """The model, learned from the text and language of a bounded sample of the rows that are not held out."""
    labelled = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(common.NULL_ID)).alias("doc_id"),
        docs[lang_col].cast("string").alias("lang"),
        held_out(docs[id_col]).alias("held_out"),
        docs[text_col].cast("string").alias("text"),
    ).where("not held_out and lang is not null and text is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = lambda rows, by, keys: rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= PER_LANGUAGE)
    # of each part of a language first, so that a common language isn't one task's
    ids = labelled.select("doc_id", "lang").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)))
    chosen = first(first(ids, order, ["lang", "part"]).drop("rank"), order, ["lang"])
    chosen = chosen.orderBy("rank", "lang").limit(SAMPLE)
    chosen = common.table(chosen.select("doc_id").distinct(), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counted = [np.unique(b, return_counts=True) for b in features(utf8(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "lang", "size", "digest")),
                    *(lists([x[i].astype(np.int32) for x in counted], pa.int32()) for i in (0, 1)),
                ],
                ["doc_id", "lang", "size", "digest", "buckets", "counts"],
            )

    sample = labelled.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text")
    # ids may repeat: the bound is one of rows
    sample = first(sample, [*order, F.xxhash64("text")], ["lang"]).orderBy("rank", "lang").limit(SAMPLE)
    sample = sample.select("doc_id", "lang", F.length("text").alias("size"), F.xxhash64("text").alias("digest"), "text")
    rows = sample.mapInArrow(run, "doc_id long, lang string, size int, digest long, buckets array<int>, counts array<int>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("size", "ascending"), ("digest", "ascending")])
    arrays = [[np.asarray(x.values) for x in rows[c]] for c in ("buckets", "counts")]
    languages = rows["lang"].to_pylist()
    mixed = np.random.Generator(np.random.PCG64(1)).permutation(len(languages))
    return train(sorted(set(languages)), [(languages[i], arrays[0][i], arrays[1][i]) for i in mixed])


def language_id(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1), accepted, and with ``keep`` a struct ``row`` of
    those columns of ``docs``.

    lang_pred is a language of the labelled rows, or "und" where the text is null or has no letter, or where there are
    no labelled rows; those have score 0 and are not accepted.  The prediction reads the whole text and nothing else.
    ``accepted`` is false also below the calibrated score.  A null id is held out or not as the empty string is; repeated
    rows are predicted each; other columns are ignored; an empty table gives no rows."""
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        held_out(docs[id_col]).alias("held_out"),
        *([F.struct(*keep).alias("row")] if keep else []),
    )
    kept = [f for f in rows.schema.fields if f.name != "text"]
    shape = T.StructType(list(kept)).add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            found = [model.predict(t or "", b) for t, b in zip(texts, features([(t or "").encode() for t in texts]))]
            more = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *more], shape.names)

    return rows.mapInArrow(run, shape)
