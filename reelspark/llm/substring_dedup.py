"""Substring deduplication by seed and extend.

A window is ``width`` consecutive words of one document; a window is repeated in a document when its words also start in
a document with a smaller id.  The words that repeated windows cover are removed.

1. Seed: a window's anchor is the smallest hash of its k-word grams, so documents that share a window share its anchor.
   Neighbouring windows of one anchor are a run; a document has a run for about every (width - k + 1) / 2 words.
   Documents are joined on anchors: an anchor of one text only ends here.  Equal documents are one class, whose first
   document stands for it.
2. Extend: a run is extended both ways, to all words that its windows hold.  Runs of an anchor that agree on all of them
   are one match, and all but its first document repeat every window of it: one row a run, never a pair.
3. At the ends of a passage runs of one anchor differ.  Of those the first document of each match compares window by
   window: a window's group, by anchor and hash, is a minimum, combined before the shuffle.
4. Neighbouring repeated windows make maximal repeats (start, end) of at least ``width`` words; their words go.

Texts are told apart by SHA-256 (its first 128 bits); runs and windows by 64-bit hashes among those of one anchor, which
is a 64-bit hash of words they hold: two different ones are taken as equal with probability 2^-64 a pair of one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernels import Words, chunks, lists, signed, sliced, sliding_min, utf8

#: Words of a seed.
SEED_WORDS = 25


def _sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _runs(words: Words, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(texts, begins, ends, anchors, matches) of the runs of some texts, in order: the text, its first and its last window
    of the run, its anchor and the hash of all words that the run holds."""
    firsts = words.bounds[:-1]
    windows = np.maximum(np.diff(words.bounds) - width + 1, 0)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    text = np.repeat(np.arange(len(firsts)), windows)
    at = firsts[text] + np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    low = sliding_min(words.grams(k), width - k + 1)[at]
    begins = np.append(0, np.flatnonzero((low[1:] != low[:-1]) | (text[1:] != text[:-1])) + 1)
    ends = np.append(begins[1:] - 1, len(low) - 1)
    first = firsts[text[begins]]
    return text[begins], at[begins] - first, at[ends] - first, low[begins], words.spans(at[begins], at[ends] + width, 31)


def _each(texts: list[bytes], width: int, k: int) -> Iterator[tuple[Words, int, int, tuple[np.ndarray, ...] | None]]:
    """For each text the object that holds its words, where there its bytes and its words begin, and the begins, ends,
    anchors and matches of its runs; None if it has no window."""
    for a, b in chunks(texts):
        words = Words(texts[a:b])
        of, *runs = _runs(words, width, k)
        cuts = np.searchsorted(of, np.arange(b - a + 1)).tolist()
        for at, p, x, y in zip(words.offsets.tolist(), words.bounds.tolist(), cuts[:-1], cuts[1:]):
            yield words, at, p, tuple(r[x:y] for r in runs) if y > x else None


def _anchors(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n_words, sha (of all words, as hex), c and c2 (its first bytes), anchors and matches of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = utf8(batch.column("text"))
            n, anchors, matches, counts = [], [], [], []
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                of, _, _, anchor, match = _runs(words, width, k)
                order = np.lexsort((match, of))
                of, anchor, match = of[order], anchor[order], match[order]
                once = np.ones(len(of), bool)
                once[1:] = (of[1:] != of[:-1]) | (match[1:] != match[:-1])
                n.append(np.diff(words.bounds))
                anchors.append(anchor[once])
                matches.append(match[once])
                counts.append(np.bincount(of[once], minlength=b - a))
            if texts:
                shas = [_sha(t.split()) for t in texts]
                first = np.frombuffer(b"".join(x[:16] for x in shas), np.int64).reshape(-1, 2)
                offsets = pa.array(np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int32))
                listed = lambda parts: pa.ListArray.from_arrays(offsets, pa.array(signed(np.concatenate(parts))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.concatenate(n), pa.int64()),
                        pa.array([x.hex() for x in shas]),
                        pa.array(first[:, 0]),
                        pa.array(first[:, 1]),
                        listed(anchors),
                        listed(matches),
                    ],
                    ["doc_id", "n_words", "sha", "c", "c2", "anchors", "matches"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, sha string, c long, c2 long, anchors array<long>, matches array<long>")


def _window_hashes(words: Words, at: np.ndarray, width: int) -> np.ndarray:
    return words.spans(at, at + width, 37)


def _windows(docs: DataFrame, width: int, k: int) -> DataFrame:
    """Of documents with matches (``open``): doc_id, anchors and hashes of the windows of those runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, wanted = utf8(batch.column("text")), batch.column("open")
            offsets, flat = wanted.offsets.to_numpy(), np.asarray(wanted.values).view(np.uint64)
            anchors, hashes = [], []
            for i, (words, _, p, runs) in enumerate(_each(texts, width, k)):
                own = flat[offsets[i] : offsets[i + 1]]
                if runs is None:
                    at = at_run = np.zeros(0, np.int64)
                else:
                    begins, ends, low, match = runs
                    sizes = np.where(np.isin(match, own), ends - begins + 1, 0)
                    at_run = np.repeat(np.arange(len(begins)), sizes)
                    at = begins[at_run] + np.arange(len(at_run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                anchors.append(signed(runs[2][at_run]) if runs else np.zeros(0, np.int64))
                hashes.append(signed(_window_hashes(words, p + at, width)))
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), lists(anchors, pa.int64()), lists(hashes, pa.int64())], ["doc_id", "anchors", "hashes"]
                )

    shape = "doc_id long, anchors array<long>, hashes array<long>"
    return docs.select("doc_id", "text", "open").mapInArrow(run, shape)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the spans (end excluded) cover."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def repeats(docs: DataFrame, width: int = 50, k: int = SEED_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, copies, parts): ``all`` has doc_id, c, c2, n_words, sha of each row; ``copies`` has (c, c2) of a text and the
    first document ``rep`` that has it; ``parts`` has doc_id, matches (runs that are repeated as a whole) and hashes (of
    further repeated windows) of documents that stand for their class.  ``docs`` comes from ``keyed``."""
    seen = common.table(_anchors(docs, width, k), "anchors")
    copies = common.table(seen.groupBy("c", "c2").agg(F.min("doc_id").alias("rep")), "copies")
    runs = seen.where(F.size("anchors") > 0).select(F.explode(F.arrays_zip("anchors", "matches")).alias("r"), "c", "c2")
    runs = runs.select(F.col("r.anchors").alias("anchor"), F.col("r.matches").alias("match"), "c", "c2")
    shared = runs.groupBy("anchor").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("anchor")
    shared = common.table(shared, "shared")
    # as a table of its own, so that Spark can split the join where an anchor is in a great many documents
    seeds = common.table(runs.join(shared, "anchor"), "seeds")
    held = seeds.join(copies, ["c", "c2"]).select("anchor", "match", F.col("rep").alias("doc_id")).distinct()
    held = common.table(held, "held")
    common.drop(shared, seeds)

    matches = held.groupBy("anchor", "match").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    matches = common.table(matches, "matches")
    same = held.join(matches.where("first < last").select("anchor", "match", "first"), ["anchor", "match"]).where("doc_id > first")
    several = matches.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor")
    several = common.table(several, "several")
    ends = matches.join(several, "anchor").groupBy(F.col("first").alias("doc_id")).agg(F.collect_set("match").alias("open"))
    ends = common.table(ends, "ends")
    spread = common.table(_windows(common.pick(docs, ends, "doc_id"), width, k), "windows")
    each = spread.select("doc_id", F.explode(F.arrays_zip("anchors", "hashes")).alias("w"))
    each = each.select("doc_id", F.col("w.anchors").alias("anchor"), F.col("w.hashes").alias("hash"))
    first = each.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = common.table(first.select("anchor", "hash", "first"), "first")
    again = each.join(first, ["anchor", "hash"]).where("doc_id > first")
    nothing = lambda kind: F.lit(None).cast(kind)
    found = same.select("doc_id", "match", nothing("long").alias("hash")).unionByName(again.select("doc_id", nothing("long").alias("match"), "hash"))
    parts = found.groupBy("doc_id").agg(F.collect_set("match").alias("matches"), F.collect_set("hash").alias("hashes"))
    parts = common.table(parts, "repeats")
    members = common.table(seen.drop("anchors", "matches"), "members")
    common.drop(seen, held, matches, several, ends, spread, first)
    return members, copies, parts


def _cut(docs: DataFrame, width: int, k: int) -> DataFrame:
    """Of documents with repeated runs and windows: doc_id, c and c2 (of its words), n_removed, kept_sha256, kept_text (the
    text without the removed words; the white space around kept words stays), repeats (start and end, in words, of each
    removed span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, out = utf8(batch.column("text")), []
            listed = [batch.column(x) for x in ("matches", "hashes")]
            at = [(x.offsets.to_numpy(), np.asarray(x.values).view(np.uint64)) for x in listed]
            for i, (words, offset, p, runs) in enumerate(_each(texts, width, k)):
                text, (known, single) = texts[i], (v[o[i] : o[i + 1]] for o, v in at)
                n = 0 if runs is None else int(runs[1][-1]) + width
                # by what they hold, as another row with this id may have other texts
                begins = ends = single = np.flatnonzero(np.isin(_window_hashes(words, p + np.arange(max(0, n - width + 1)), width), single))
                if runs is not None:
                    whole = np.isin(runs[3], known)
                    begins, ends = runs[0][whole], runs[1][whole]
                    begins, ends = np.append(begins, single), np.append(ends, single)
                ends = ends + width
                gone = covered(begins.astype(np.int64), ends.astype(np.int64), n)
                kept = [w for w, g in zip(text.split(), gone.tolist()) if not g]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                left, done = [], 0
                for a, b in zip(edge[0::2], edge[1::2]):
                    left.append(text[done : int(words.starts[p + a]) - offset])
                    done = int(words.starts[p + b]) - offset if b < n else len(text)
                spans = [{"start": a, "end": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]
                own = np.frombuffer(_sha(text.split())[:16], np.int64).tolist()
                out.append((*own, int(gone.sum()), _sha(kept).hex(), b"".join([*left, text[done:]]).decode(), spans))
            if out:
                c, c2, removed, sha, text, spans = zip(*out)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (c, c2, removed)), pa.array(sha), pa.array(text, pa.string()), pa.array(spans, kind)],
                    ["doc_id", "c", "c2", "n_removed", "kept_sha256", "kept_text", "repeats"],
                )

    shape = "doc_id long, c long, c2 long, n_removed long, kept_sha256 string, kept_text string, repeats array<struct<start:int,end:int>>"
    return docs.select("doc_id", "text", "matches", "hashes").mapInArrow(run, shape)


def substring_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", k: int = SEED_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept_text
    (the text without the removed words; null where nothing goes, so the text stands as it is), repeats (the removed
    spans, as words' numbers, end excluded; null where nothing goes).

    Words are runs of characters other than ASCII white space, unchanged.  A null or blank text has no words; a text of
    fewer than ``width`` words loses nothing.  Rows of the same id do not repeat one another; a null id counts as the
    smallest and is given back as null; rows of one id with different texts keep their own words each.  Other columns are ignored; an empty table gives no rows."""
    docs = common.keyed(docs, id_col, text_col)
    seen, copies, parts = repeats(docs, width, k)
    cut = _cut(common.pick(docs, parts, "doc_id"), width, k).where("n_removed > 0").dropDuplicates(["doc_id", "c", "c2"])
    rows = seen.join(copies, ["c", "c2"]).join(cut, ["doc_id", "c", "c2"], "left")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= width)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return rows.select(
        common.shown(F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(copy, everything).otherwise(F.col("repeats")).alias("repeats"),
    )
