"""Ports for models: text encoders and rerankers are given as functions on lists; the engine batches, spreads and checks.

``hashing_encoder`` is the deterministic stand-in of tests: it is not a model of meaning.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from . import sequences

Encoder = Callable[[list[str]], np.ndarray]


@functools.lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def hashing_encoder(size: int = 64) -> Encoder:
    """Signed hashed word counts, of length 1."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, t in zip(out, texts):
            hashes = np.array([_word_hash(w) for w in t.lower().split()], np.uint64)
            row += np.bincount((hashes % np.uint64(size)).astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0), size)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encode(rows: DataFrame, text: str, encoder: Encoder, batch: int = 256) -> DataFrame:
    """``embedding`` of each row's text; every distinct text is encoded once, and joined back by its digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                vectors = encoder(part["t"].tolist())
                if len(vectors) != len(part) or not np.isfinite(vectors).all():
                    raise ValueError("the encoder gave too few or non-finite vectors")
                yield pd.DataFrame({"h": part["h"].to_numpy(), "embedding": list(vectors.astype(np.float32))})

    hashed = rows.withColumn("h", F.md5(text))
    distinct = hashed.where(F.length(F.trim(text)) > 0).groupBy("h").agg(F.first(text).alias("t"))
    return hashed.join(distinct.mapInPandas(run, "h string, embedding array<float>"), "h", "left").drop("h")


def rerank(ranked: DataFrame, score: Callable[[pd.DataFrame], np.ndarray], top: int) -> DataFrame:
    """``place``: the best ``top`` of each query by a second score, equal ones as they were; the tail keeps its order.
    Where the scorer fails for a batch, that batch keeps its order, and ``failed`` says so."""
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in ranked.schema.fields) + ", second double, failed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                s = np.asarray(score(b), float)
                good = len(s) == len(b) and np.isfinite(s).all()
            except Exception:  # noqa: BLE001  a model's failure only costs the second order
                good = False
            yield b.assign(second=s if good else np.zeros(len(b)), failed=not good)

    head = ranked.where(F.col("rank") <= top).mapInPandas(run, schema)
    both = head.unionByName(ranked.where(F.col("rank") > top).withColumns({"second": F.lit(None).cast("double"), "failed": F.lit(False)}))
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("second"), "rank")
    return both.withColumn("place", F.row_number().over(order))


def isolated(call: Callable[[list], list], items: list) -> list[tuple[object, str | None]]:
    """(result, error) of each item of a batch.  Where a call fails, its batch is halved until the items that make it fail
    are alone; only those have an error (the exception's name and first line), the others their results."""
    if not items:
        return []
    try:
        results = list(call(items))
        if len(results) != len(items):
            raise ValueError(f"{len(results)} results for {len(items)} items")
        return [(r, None) for r in results]
    except Exception as e:  # noqa: BLE001  whatever a model raises is a row's failure
        if len(items) == 1:
            return [(None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300])]
    half = len(items) // 2
    return isolated(call, items[:half]) + isolated(call, items[half:])


#: (answers, frame_ids, confidences) for the texts, kinds and frames of some windows.
Answerer = Callable[[list[str], list[str], list[list[int]]], tuple[list[str], list[int], list[float]]]
#: What is told of a call besides errors.
NOT_SHOWN, AGAIN = "frame_not_shown", "temporal_neighbor_fallback"


def answer(windows: DataFrame, answerer: Answerer, most: int = 8, sure: float = 0.4) -> DataFrame:
    """A row for each call of the model: question, kind, place, call (from 1), retried, answer, frame_id, confidence, warnings.

    ``windows`` has question, kind, place, text, frames and wide (lists of frames, wide null if there is no more to show).
    A question's windows are asked in order of place, until ``most`` calls were made.  If the answer to a window of a
    TEMPORAL question is missing or not ``sure``, the window is asked again with the wide frames, which is a call of the
    ``most`` too; both answers stay.  An answer that names a frame it wasn't shown, and a call that fails, is no answer: it
    is null, and the reason is among the warnings.

    Questions take turns: one call of each is a batch for the model, so batches stay full though each call of a question
    depends on those before."""
    key = windows.schema["question"]
    schema = f"question {key.dataType.simpleString()}, kind string, place int, call int, retried boolean, answer string, frame_id long, confidence double, warnings array<string>"

    def called(rows: list[tuple[dict, list[int]]]) -> list[tuple]:
        def model(batch: list) -> list:
            return list(zip(*answerer([r["text"] for r, _ in batch], [r["kind"] for r, _ in batch], [f for _, f in batch])))

        out = []
        for (got, error), (_, shown) in zip(isolated(model, rows), rows):
            if error is None and got[1] not in shown:
                got, error = None, NOT_SHOWN
            out.append((got, error))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in sequences.groups(batches, ["question"]):
            rows = table.to_pylist()
            waiting = [iter(rows[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            turn: list[tuple[int, dict, bool]] = []  # (question, window, again)
            calls, out = [0] * len(waiting), []
            live = list(range(len(waiting)))
            again: dict[int, dict] = {}
            while live:
                turn = []
                for q in live:
                    w = again.pop(q, None)
                    retried = w is not None
                    w = w if retried else next(waiting[q], None)
                    if w is not None:
                        turn.append((q, w, retried))
                found = called([(w, list(map(int, w["wide"] if retried else w["frames"]))) for _, w, retried in turn])
                live = []
                for (q, w, retried), (got, error) in zip(turn, found):
                    calls[q] += 1
                    said = ([AGAIN] if retried else []) + ([error] if error else [])
                    out.append((w["question"], w["kind"], w["place"], calls[q], retried, *(got or (None, None, None)), said))
                    if calls[q] < most:
                        live.append(q)
                        unsure = got is None or got[2] < sure
                        if not retried and w["kind"] == "TEMPORAL" and unsure and w["wide"] is not None:
                            again[q] = w
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=shape)

    spec = DataType.fromDDL(schema)
    names, shape = spec.fieldNames(), to_arrow_schema(spec)
    first = windows.where(F.col("place") <= most).select("question", "kind", F.col("place").cast("int").alias("place"), "text", "frames", "wide")
    return first.repartition("question").sortWithinPartitions("question", "place").mapInArrow(run, schema)
