"""Improbable-feature digests of documents.

Every window of WINDOW bytes is a feature, ranked by the entropy of its byte values: windows of an entropy that is common
in ordinary text rank high, those of unusual entropy, the improbable ones, low; runs of one byte are left out.  In every
stretch of NEAR neighbouring windows the lowest rank scores, and windows that score often enough are selected.  Selected
features are hashed into a chain of Bloom filters of at most FEATURES each.  Two digests are compared by the overlap of
their filters' bits, normalised between the overlap that chance gives and the largest possible one.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernels import U64, mix, powers, sliced, sliding_min

WINDOW, NEAR, SCORE = 64, 64, 16
BITS, HASHES, FEATURES = 2048, 5, 160
#: Byte values are counted in 32 classes (letters without case); eight classes share a 64-bit word of counters.
_CLASS = np.arange(256) & 31
_STEP = [np.where(_CLASS // 8 == g, U64(1) << (U64(8) * (_CLASS % 8).astype(U64)), U64(0)) for g in range(4)]
_C = np.arange(256, dtype=np.float64)
_PLOGP = np.where(_C > 0, _C / WINDOW * np.log2(np.maximum(_C, 1) / WINDOW), 0.0)
_PAIR = (_PLOGP[:, None] + _PLOGP[None, :]).astype(np.float32).ravel()
#: The entropy (bits) of an ordinary text window; the further from it, the rarer.
ORDINARY, LEAST = 4.0, 1.0
_R, _RINV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
PART = 1 << 20
#: Id ranges for each partition, so that hashing them to partitions comes out even; text that a partition holds at most.
BLOCKS, PART_BYTES = 4, 1 << 27


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy in bits of each window of bytes."""
    n = len(data) - WINDOW + 1
    out = np.zeros(n, np.float32)
    present = np.unique(_CLASS[np.flatnonzero(np.bincount(data, minlength=256))] // 8)
    for g in present.tolist():
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_STEP[g][data], out=total[1:])
        counts = (total[WINDOW:] - total[:-WINDOW]).view(np.uint16).reshape(n, 4)
        for i in range(4):
            out -= _PAIR[counts[:, i]]
    return out


def selected(data: np.ndarray) -> np.ndarray:
    """Where the selected features of some bytes begin."""
    entropy = entropies(data)
    # a rank is 0 for the entropy furthest from ordinary; ties go to the first window
    rank = (1 << 20) - np.minimum((np.abs(entropy - ORDINARY) * 65536).astype(np.int64), 1 << 20)
    rank = np.where(entropy < LEAST, 1 << 21, rank)
    keyed = (rank << 40) | np.arange(len(rank))
    low = sliding_min(keyed, min(NEAR, len(keyed))) & ((1 << 40) - 1)
    score = np.bincount(low, minlength=len(rank))
    return np.flatnonzero((score >= min(SCORE, len(low))) & (entropy >= LEAST))


def features(text: bytes, after: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the selected features of a text that begin at ``after`` or later; a text shorter than a window
    is one feature.  Whether a window is selected depends on the NEAR windows on either side of it alone."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < WINDOW:
        return np.zeros(min(1, len(text)), np.int64), np.frombuffer(hashlib.blake2b(text, digest_size=8).digest() if text else b"", U64)
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for at in range(after, len(data) - WINDOW + 1, PART):
        begin = max(0, at - NEAR)
        part = data[begin : at + PART + WINDOW + NEAR]
        where = selected(part)
        where = where[(where + begin >= at) & (where + begin < at + PART)]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * powers(_R, len(part)), out=total[1:])
        places.append(where + begin)
        hashes.append(mix((total[where + WINDOW] - total[where]) * powers(_RINV, len(part))[where], 9))
    return np.concatenate(places), np.concatenate(hashes)


def changed(found: tuple[np.ndarray, np.ndarray], text: bytes, new: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The features of ``new``, given those of ``text``: far enough before the first difference they are the same."""
    same = 0
    if len(text) >= WINDOW and len(new) >= WINDOW:
        size = min(len(text), len(new))
        differ = np.flatnonzero(np.frombuffer(text, np.uint8, size) != np.frombuffer(new, np.uint8, size))
        same = max(0, (int(differ[0]) if len(differ) else size) - WINDOW - NEAR)
    places, hashes = found
    keep = places < same
    more = features(new, same)
    return np.concatenate([places[keep], more[0]]), np.concatenate([hashes[keep], more[1]])


def chained(hashes: np.ndarray) -> np.ndarray:
    """The chain of filters (rows of BITS bits as bytes) of features in order of place; repeated ones count once."""
    _, first = np.unique(hashes, return_index=True)
    own = hashes[np.sort(first)]
    filters = np.zeros((-(-len(own) // FEATURES), BITS), bool)
    row = np.arange(len(own)) // FEATURES
    for i in range(HASHES):
        filters[row, ((own >> U64(11 * i)) % U64(BITS)).astype(np.int64)] = True
    return np.packbits(filters, axis=1)


def digest(text: bytes) -> np.ndarray:
    return chained(features(text)[1])


def shown(filters: np.ndarray) -> str:
    """A digest as text: the number of filters and their bits in base 64."""
    return f"{len(filters)}:{base64.b64encode(filters.tobytes()).decode()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, averaged by their features."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    nx, ny = x.sum(1), y.sum(1)
    common_ = x @ y.T
    most = np.minimum(nx[:, None], ny[None, :])
    chance = nx[:, None] * ny[None, :] / BITS
    cut = chance + 0.1 * (most - chance)
    score = np.clip((common_ - cut) / np.maximum(most - cut, 1e-9), 0, 1)
    return float((score.max(1) * nx).sum() / nx.sum())


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many first ones (or all) of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (block, spare, doc_id, text) so dealt that a partition, in order of block, spare and id, holds each document of
    a block before the one that follows it; ``spare`` rows are the first of the next block, for looking ahead only."""
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    ranges = ids.repartitionByRange(BLOCKS * parts, "doc_id").groupBy(F.spark_partition_id().alias("p"))
    lows = np.array(sorted(r.lo for r in ranges.agg(F.min("doc_id").alias("lo")).collect()), np.int64)  # one id for each block

    @F.pandas_udf("long")
    def place(column: pd.Series) -> pd.Series:
        """Twice the block, and 1 if the id is the block's first."""
        block = np.searchsorted(lows, column.to_numpy(), side="right") - 1
        return pd.Series(2 * block + (lows[block] == column.to_numpy()))

    last = max(0, len(lows) - 1)
    blocked = docs.withColumn("place", place("doc_id")).withColumn("block", F.shiftright("place", 1).cast("int"))
    leads = F.col("place") % 2 == 1
    before = F.when(F.col("block") == 0, F.lit(last)).otherwise(F.col("block") - 1)
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("spare"))
    ahead = F.struct(before.cast("int").alias("block"), F.lit(True).alias("spare"))
    rows = blocked.select(F.explode(F.when(leads, F.array(own, ahead)).otherwise(F.array(own))).alias("b"), "doc_id", "text")
    rows = rows.select("b.block", "b.spare", "doc_id", "text").repartition(parts, "block")
    return rows.sortWithinPartitions("block", "spare", "doc_id", F.xxhash64("text"), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness of its fingerprint to that of its edited text and of the next document).

    The next document is the one of the next id; after the last comes the first.  Rows of one id follow one another by
    their texts; a null id comes first.  A null or empty text has an empty digest, which is like an empty one only.
    Other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            waiting, given = None, None  # a block's last document so far; the last spare one used
            for batch in sliced(batches, 64):
                for block, spare, doc, text in zip(*(batch.column(c).to_pylist() for c in ("block", "spare", "doc_id", "text"))):
                    text = text or ""
                    if spare and given == block:
                        continue
                    found = features(text.encode())
                    prints = chained(found[1])
                    if waiting is not None and waiting[0] == block:
                        yield (*waiting[1:], text, prints)
                    waiting, given = (None, block) if spare else ((block, doc, text, found, prints), given)

        out: list[tuple] = []
        for doc, text, found, own, following, next_prints in rows():
            new = edited(text, following).encode()
            other = chained(changed(found, text.encode(), new)[1])
            sha = hashlib.sha256(new).hexdigest()
            out.append((doc, len(text), sha, shown(own), shown(other), likeness(own, other), likeness(own, next_prints)))
            if len(out) == 256:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    result = in_order(common.keyed(docs, id_col, text_col)).mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in _COLUMNS))
    return result.withColumn("doc_id", common.shown(F.col("doc_id")))


_COLUMNS = [
    ("doc_id", "long", pa.int64()),
    ("n_chars", "long", pa.int64()),
    ("edited_sha256", "string", pa.string()),
    ("fingerprint", "string", pa.string()),
    ("edited_fingerprint", "string", pa.string()),
    ("near_edited", "double", pa.float64()),
    ("near_next", "double", pa.float64()),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(zip(*rows), _COLUMNS)], [n for n, _, _ in _COLUMNS])
