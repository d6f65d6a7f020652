"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are encoded, ended by a token and, only where longer than a sequence, cut.  Full pieces are sequences of their
own.  The other pieces are packed in rounds: every partition packs its items best-fit, largest first, and lets go of the
nearly full bins; the underfull ones are the items of the next round, in an eighth of the partitions.  A bin carries the
list of its pieces, at most as many as a sequence has tokens.  A task gets at most ITEMS_PER_TASK items; rounds end when
one partition has packed the rest, or when another round would hardly save a bin.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernels import sliced
from .pretoken import Kept, fits, latin

FAN_IN = 8
ITEMS_PER_TASK = 200_000
#: A bin with at most this many free tokens is nearly full.
SLACK = 8


class Encoder:
    """Token ids of a text as packed little-endian 32-bit numbers, by the library, each pre-token encoded once."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = fits(spec) and not spec.get("post_processor")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.kept = Kept(self.whole, 500_000)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        pieces = latin(text) if self.fast and not any(s in text for s in self.special) else None
        return self.whole(text) if pieces is None else b"".join(map(self.kept.__getitem__, pieces))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document (columns of PIECE)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(run, PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin.  Bins are found by their free space in a bit mask."""
    free: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    mask = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = free[room].popleft()
            if not free[room]:
                mask &= ~(1 << room)
            bins[b].append(item)
            room -= size
        else:
            b, room = len(bins), capacity - size
            bins.append([item])
        if room:
            free[room].append(b)
            mask |= 1 << room
    return bins


def _pack(bins: DataFrame, capacity: int) -> DataFrame:
    """Bins (fill, members) of each partition, packed together best-fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if all_ is None or not all_.num_rows:
            return
        packed = best_fit(all_["fill"].to_numpy(), capacity)
        order = pa.array(np.concatenate([np.array(b) for b in packed]))
        members = all_["members"].combine_chunks().take(order)
        members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
        ends = np.append(0, np.asarray(members.offsets)[1:] - members.offsets[0].as_py())
        cut = ends[np.cumsum([0] + [len(b) for b in packed])].astype(np.int32)
        sums = np.add.reduceat(all_["fill"].to_numpy()[order.to_numpy()], np.cumsum([0] + [len(b) for b in packed[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(cut), members.flatten())
        for at in range(0, len(cut) - 1, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(sums[at : at + 10_000]), lists.slice(at, 10_000)], ["fill", "members"])

    return bins.mapInArrow(run, bins.schema)


def pack_pieces(items: DataFrame, capacity: int) -> DataFrame:
    """Pieces (a written table with the columns of PIECE) with sequence_id and offset."""
    member = F.struct(*[c.split()[0] for c in PIECE.split(", ")])
    bins = items.select(F.col("length").alias("fill"), F.array(member).alias("members"))
    full = F.col("fill") >= capacity
    done, rest = [bins.where(full)], bins.where(~full)
    left = rest.count()
    parts = max(1, -(-left // (ITEMS_PER_TASK // FAN_IN)))
    while left:
        packed = common.table(_pack(rest.repartition(parts), capacity), "bins")
        under = packed.where(F.col("fill") < capacity - SLACK)
        now = under.count()
        least = max(1, -(-now // ITEMS_PER_TASK))
        if parts == 1 or (parts <= least and now > 0.99 * left):
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") >= capacity - SLACK))
        rest, left, parts = under, now, max(least, parts // FAN_IN)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumn("sequence_id", F.monotonically_increasing_id())
    start = F.struct(F.array().cast("array<long>").alias("before"), F.lit(0).cast("long").alias("total"))
    before = F.aggregate(
        "members",
        start,
        lambda s, m: F.struct(F.concat(s["before"], F.array(s["total"])).alias("before"), (s["total"] + m["length"]).alias("total")),
        lambda s: s["before"],
    )
    zipped = out.select("sequence_id", F.explode(F.arrays_zip(F.col("members").alias("m"), before.alias("offset"))).alias("x"))
    return zipped.select("x.m.*", "sequence_id", F.col("x.offset").alias("offset"))


def best_fit_packing(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: doc_id, piece (from 0), start (its document's ids before it), length, ids_crc32 (of its ids as
    little-endian 32-bit numbers), sequence_id, offset (its place in the sequence; sequences are gapless from 0).

    A document is the ids that the vocabulary file ``path`` gives its whole text, then ``end_id``; only one of more than
    ``capacity`` ids is cut.  A null or empty text is the end token alone.  Repeated rows are packed each; null ids stay
    null; other columns are ignored; an empty table gives no rows."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return pack_pieces(common.table(pieces(rows, path, capacity, end_id), "pieces"), capacity)
