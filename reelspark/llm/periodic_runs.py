"""Periodic runs of words, by recursive frequency splitting and a scan of lags.

A run is a stretch of consecutive words of smallest period q, of at least max(least, times * q) words, that no
neighbouring word extends.

1. Split: every word of a run occurs in it ``times`` times or more.  So a word that is rarer within its segment (at first
   the whole text) is in no run and splits the segment; pieces shorter than ``least`` words go.  Segments that were split
   are counted again, until none is.  A run is never cut, and the word beside it is not one that would have extended it.
2. Scan: periods q of (k/2, k] are looked for with grams of k words, k = 1, 2, 4, ...  Within a run of period q the next
   occurrence of such a gram is q words on, never nearer (the root of a run is primitive), so a run is exactly a longest
   stretch of places whose next gram is q words on.  Grams are numbered by pairs of numbers of half their length, which
   makes the scan exact, and of n log n time for each k, however long a text is and whatever it repeats.

Words are told apart by 64-bit hashes.  Texts are worked on in tasks, each alone: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import Words, chunks, sliced, utf8

#: A run has LEAST words at least, and TIMES its period.
LEAST, TIMES = 6, 4


def _segments(at: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (sorted) that are in stretches of neighbours of one ``of`` of at least ``least``, and each one's stretch."""
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
    stretch = np.cumsum(first) - 1
    keep = np.bincount(stretch)[stretch] >= least if len(at) else first
    return at[keep], stretch[keep]


def split(ids: np.ndarray, docs: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """The places of the words that survive, sorted, and the segment each is in."""
    at, seg = _segments(np.arange(len(ids)), docs, least)
    settled = []
    while len(at):
        _, which, counts = np.unique(seg * (ids.max() + 1) + ids[at], return_inverse=True, return_counts=True)
        often = counts[which] >= times
        stable = np.ones(seg[-1] + 1, bool)
        stable[seg[~often]] = False
        done = stable[seg]
        settled.append(at[done])
        rest = often & ~done
        at, seg = _segments(at[rest], seg[rest], least)
    at = np.sort(np.concatenate(settled)) if settled else at
    return _segments(at, docs[at], least)


def _scan(ids: np.ndarray, seg: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, period) of the runs among words in segments; begins are places in ``ids``."""
    sizes = np.bincount(seg)
    ends = np.cumsum(sizes)[seg]
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    place, rank, k = np.arange(len(ids)), ids.astype(np.int64), 1
    while True:
        # the places of grams of k words, in segments with room for a period above k/2
        place = place[(ends[place] - place >= k) & (sizes[seg[place]] >= max(least, times * (k // 2 + 1)))]
        if not len(place):
            break
        key = rank[place] if k == 1 else rank[place] * (len(ids) + 1) + rank[place + k // 2]
        order = np.argsort(key, kind="stable")
        place_of, key = place[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        rank = np.full(len(ids), -1, np.int64)
        rank[place_of] = np.cumsum(new) - 1
        gap = np.zeros(len(ids) + 1, np.int64)
        near = np.append(~new[1:] & (seg[place_of[1:]] == seg[place_of[:-1]]), False)
        gap[place_of[near]] = place_of[1:][near[:-1]] - place_of[near]
        gap[(gap > k) | (gap <= k // 2)] = 0
        edge = np.flatnonzero(np.append(True, (gap[1:-1] != gap[:-2]) | (seg[1:] != seg[:-1])))
        q, length = gap[edge], np.append(edge[1:], len(ids)) - edge + k - 1
        length = np.where(q > 0, length + q, 0)
        good = (q > 0) & (length >= np.maximum(least, times * q))
        found.append((edge[good], length[good], q[good]))
        k *= 2
    return tuple(np.concatenate(x) for x in zip(*found))


def runs(words: Words, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of several texts, by text, start and period."""
    docs = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    ids = np.unique(words.hashes, return_inverse=True)[1]
    at, seg = split(ids, docs, least, times)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    begin, length, period = _scan(ids[at], seg, least, times)
    text, start = docs[at[begin]], at[begin] - words.bounds[docs[at[begin]]]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _described(text: bytes, found: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the best run's start, length, period and exponent, the runs, both digests, the collapsed text or None."""
    kept, best = text.split(), None
    if found:
        gone = np.zeros(len(kept) + 1, np.int64)
        for start, length, period in found:
            gone[start + period] += 1
            gone[start + length] -= 1
            if best is None or length * best[2] > best[1] * period:
                best = (start, length, period)
        kept = [w for w, g in zip(kept, np.cumsum(gone).tolist()) if not g]
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    joined = b" ".join(kept)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    exponent = 1000 * best[1] // best[2] if best else None
    spans = [{"start": a, "length": b, "period": c} for a, b, c in found]
    return len(found), *(best or (None,) * 3), exponent, spans, digest(listed.encode()), digest(joined), joined.decode() if found else None


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_runs; start, length, period and exponent_milli (1000 * length / period, rounded down)
    of the run of the greatest length / period (ties: smallest start, then period), null without runs; runs (start, length
    and period of each, by start and period); runs_sha256 (of their lines ``start,length,period``), collapsed_sha256 (of the
    words that are left, joined by one space, when all that follows the first period of a run goes), collapsed_text (these
    words; null where there is no run, so the text stands).

    Words are runs of characters other than ASCII white space, unchanged.  A null or blank text has no words and no runs.
    Repeated rows and ids are rows each, a null id stays null; other columns are ignored; an empty table gives no rows.
    ``times`` is 3 or more, as a gram of up to two periods must be seen twice in a run."""
    if times < 3:
        raise ValueError("times must be 3 or more")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [*[pa.int64()] * 5, spans, pa.string(), pa.string(), pa.string()]
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256", "collapsed_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, out = utf8(batch.column("text")), []
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                text, *of = runs(words, least, times)
                found = list(zip(*(x.tolist() for x in of)))
                cuts = np.searchsorted(text, np.arange(b - a + 1)).tolist()
                out += [_described(t, found[x:y]) for t, x, y in zip(texts[a:b], cuts[:-1], cuts[1:])]
            if out:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    shape = """doc_id long, n_runs long, start long, length long, period long, exponent_milli long,
        runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string, collapsed_text string"""
    return rows.mapInArrow(run, shape)


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The texts of the registered query: of ids whose crc32 is divisible by ten, the words from a place on are those of a
    first period over and over; others, and texts without words, stay."""
    h = F.crc32(F.encode(doc_id.cast("string"), "utf-8"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times))
    changed = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(changed, " ")).otherwise(text)
