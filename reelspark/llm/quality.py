"""Quality of texts by regularised quadratic discriminant analysis.

1. A text's statistics (STATISTICS below) are taken of the whole text, each transformed (logarithms of counts and ratios,
   logits of shares) and rounded to 1/SCALE, as a whole number.
2. Learning is one aggregate: the number, sums and sums of products of the statistics of the labelled rows of each class.
   Sums of whole numbers are exact in any order, so the model doesn't depend on how rows are dealt.  All labelled rows that
   aren't held out count; four fifths make the densities, a fifth the calibration.
3. A class's covariance is shrunk twice, by weights that its number of rows gives: towards that of both classes together,
   then (by the oracle-approximating rule of Chen et al., 2010) towards a multiple of the identity, in units of the joint
   deviations.  Its Cholesky factor is computed once; the Mahalanobis distance of a text is the norm of one triangular
   solution, and the class's log density is minus half of its square and the log of the factor's determinant.
4. The score is a logistic function of the difference of the two log densities, compressed so that far outliers don't set
   it; its slope and offset are fitted on counts of that difference among the calibration rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernels import Words, chunks, lists, sliced, utf8
from .language_id import held_out

STATISTICS = """words distinct_words repeated_word common_word word_length letters capitals digits marks doubled_marks bare_marks
sentence_ends distinct_lines line_words capital_words entropy""".split()
#: Statistics are whole multiples of 1 / SCALE, and within LIMIT of zero.
SCALE, LIMIT = 256, 16.0
#: Of the rows to learn from, one in CALIBRATE is for the calibration.
CALIBRATE = 5
#: The width of the bins of compressed differences that calibration counts.
BIN = 0.05
THRESHOLD = 0.7

_LETTER, _CAPITAL, _DIGIT, _SPACE, _END, _MARK, _STOP = (1 << i for i in range(7))


def _kind(c: str) -> int:
    general = unicodedata.category(c)
    if general[0] in "LM":
        return _LETTER | (_CAPITAL if general in ("Lu", "Lt") else 0)
    if general[0] == "N":
        return _DIGIT
    if general[0] in "ZC":
        return _SPACE
    return (_END if c in ".!?。！？" else 0) | (_STOP if c in ".,;:'\"?!-()’“”。、，" else _MARK)


_kinds: np.ndarray | None = None


def _table() -> np.ndarray:
    """What the characters of the first plane are; made once a worker.  Others count as marks."""
    global _kinds
    if _kinds is None:
        _kinds = np.array([_SPACE if 0xD800 <= i < 0xE000 else _kind(chr(i)) for i in range(1 << 16)] + [_MARK], np.uint8)
    return _kinds


def _logit(share: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The logit of a share of n, as if half a case more had been seen on both sides."""
    hits = share * n
    return np.log((hits + 0.5) / (n - hits + 0.5))


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of whole numbers for each text, a column for each of STATISTICS."""
    out = [np.zeros((0, len(STATISTICS)), np.int64)]
    for a, b in chunks(texts):
        out.append(_statistics(texts[a:b]))
    return np.concatenate(out)


def _statistics(texts: list[bytes]) -> np.ndarray:
    count = len(texts)
    words = Words(texts)
    n = np.diff(words.bounds).astype(float)
    text = np.repeat(np.arange(count), np.diff(words.bounds))
    per = lambda mask, of, size=count: np.bincount(of, weights=mask, minlength=size)
    some = np.maximum(n, 1)

    # words
    same = np.append(False, (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])) if len(text) else np.zeros(0, bool)
    order = np.lexsort((words.hashes, text))
    h, t = words.hashes[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
    sizes = np.diff(np.append(np.flatnonzero(new), len(h)))
    distinct, top = per(new, t), np.zeros(count)
    np.maximum.at(top, t[new], sizes)

    # characters
    decoded = b"\n".join(texts).decode("utf-8", "replace") + "\n"
    points = np.minimum(np.frombuffer(decoded.encode("utf-32-le", "surrogatepass"), np.uint32), 1 << 16)
    kinds = _table()[points]
    # a text ends where its line end is: as many characters before it as its bytes hold
    chars = np.array([len(x.decode("utf-8", "replace")) for x in texts])
    of = np.repeat(np.arange(count), chars + 1)
    is_ = lambda bit: (kinds & bit) != 0
    seen = per(~is_(_SPACE), of)
    letters, capitals, digits = (per(is_(x), of) for x in (_LETTER, _CAPITAL, _DIGIT))
    marks = per(is_(_MARK), of)
    twin = np.append(False, (points[1:] == points[:-1]) & (is_(_MARK) | is_(_END) | is_(_STOP))[1:])
    doubled = per(twin, of)

    # words by their characters
    space = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    first, last = edge[0::2], edge[1::2] - 1
    word_of = of[first]
    letter_sum = np.append(0, np.cumsum(is_(_LETTER) | is_(_DIGIT)))
    bare = per(letter_sum[last + 1] == letter_sum[first], word_of)
    ends = per(is_(_END)[last], word_of)
    capital_words = per(is_(_CAPITAL)[first], word_of)

    # lines that are not blank
    line = np.zeros(len(points), np.int64)
    line[1:] = np.cumsum(points == 10)[:-1]
    used = np.unique(line[first])
    begins = np.searchsorted(line[first], used)
    stops = np.append(begins[1:], len(first))
    hashes = words.spans(begins, stops) if len(begins) else np.zeros(0, np.uint64)
    line_text = word_of[begins] if len(begins) else np.zeros(0, np.int64)
    lines = per(np.ones(len(begins)), line_text)
    order = np.lexsort((hashes, line_text))
    h, t = hashes[order], line_text[order]
    distinct_lines = per(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)], t)

    # entropy of characters, folded to 256 classes
    table = np.bincount(of * 256 + (points & 255), minlength=count * 256).reshape(count, 256)
    table[:, 10] -= 1  # the line end that was added
    share = table / np.maximum(table.sum(1, keepdims=True), 1)
    entropy = -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(1)

    seen_, alpha = np.maximum(seen, 1), np.maximum(letters, 1)
    columns = {
        "words": np.log(n + 1),
        # vocabulary grows as a power of length: the power says what the ratio says, for any length
        "distinct_words": 8 * np.log(distinct + 1) / np.log(n + 2),
        "repeated_word": _logit(per(same, text) / some, n),
        "common_word": _logit(top / some, n),
        "word_length": 4 * np.log(seen_ / some),
        "letters": _logit(letters / seen_, seen),
        "capitals": _logit(capitals / alpha, letters),
        "digits": _logit(digits / seen_, seen),
        "marks": _logit(marks / seen_, seen),
        "doubled_marks": _logit(doubled / seen_, seen),
        "bare_marks": _logit(bare / some, n),
        "sentence_ends": _logit(ends / some, n),
        "distinct_lines": _logit(distinct_lines / np.maximum(lines, 1), lines),
        "line_words": np.log((n + 1) / (lines + 1)),
        "capital_words": _logit(capital_words / some, n),
        "entropy": 2 * entropy,
    }
    x = np.stack([columns[c] for c in STATISTICS], 1)
    return np.rint(np.clip(x, -LIMIT, LIMIT) * SCALE).astype(np.int64)


@dataclass(frozen=True)
class Class:
    """A density: its mean, its Cholesky factor, and the log of the factor's determinant."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = np.linalg.solve(self.factor, (x - self.mean).T)
        return -0.5 * (z**2).sum(0) - self.log_det


@dataclass(frozen=True)
class Model:
    """The densities of the classes (None where one has no rows), units of the statistics, slope and offset of the logistic."""

    good: Class | None
    bad: Class | None
    unit: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """The compressed difference of the log densities of rows of statistics."""
        if self.good is None or self.bad is None:
            return np.zeros(len(x))
        x = x / self.unit
        return np.arcsinh(self.good.log_density(x) - self.bad.log_density(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -500, 500)))


def densities(moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """From (number, sums, sums of products) of each class, 1 and 0."""
    size = len(STATISTICS)
    n = {c: m[0] for c, m in moments.items() if m[0] > 0}
    scatter = {c: moments[c][2] - np.outer(moments[c][1], moments[c][1]) / n[c] for c in n}
    joint = sum(scatter.values(), np.zeros((size, size))) / max(1, sum(n.values()) - len(n))
    unit = np.sqrt(np.maximum(np.diag(joint), 1.0))
    if set(n) != {0, 1}:
        return Model(None, None, unit)
    joint = joint / np.outer(unit, unit)
    made = {}
    for c in n:
        own = scatter[c] / max(1, n[c] - 1) / np.outer(unit, unit)
        w = size / (size + n[c])
        own = (1 - w) * own + w * joint
        mean, square, trace2 = np.trace(own) / size, np.trace(own @ own), np.trace(own) ** 2
        spread = (n[c] + 1 - 2 / size) * (square - trace2 / size)
        rho = min(1.0, ((1 - 2 / size) * square + trace2) / spread) if spread > 0 else 1.0
        # a statistic that never varies keeps a small variance, as the next text may differ
        own = (1 - rho) * own + rho * mean * np.eye(size) + 0.01 * np.eye(size)
        factor = np.linalg.cholesky(own)
        made[c] = Class(moments[c][1] / n[c] / unit, factor, float(np.log(np.diag(factor)).sum()))
    return Model(made[1], made[0], unit)


def calibrated(model: Model, bins: list[tuple[float, int, int]]) -> Model:
    """``model`` with the slope (not below 0) and offset that fit (difference, label, count) rows best, by Newton's method on
    the logistic loss with a weak pull to slope 1; with labels of one kind only, the share of it, pulled to a half."""
    if not bins:
        return model
    x, y, w = (np.array(c, float) for c in zip(*sorted(bins)))
    basis, pull, aim = np.stack([np.ones(len(x)), x], 1), np.array([0.01, 1.0]), np.array([0.0, 1.0])

    def loss(t: np.ndarray) -> float:
        z = basis @ t
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (pull * (t - aim) ** 2).sum())

    t = aim
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(basis @ t, -500, 500)))
        slope = basis.T @ (w * (p - y)) + pull * (t - aim)
        step = np.linalg.solve(basis.T @ (basis * (w * p * (1 - p))[:, None]) + np.diag(pull), slope)
        while np.abs(step).max() > 1e-9 and loss(t - step) > loss(t):
            step = step / 2
        t = t - step
        if np.abs(step).max() <= 1e-9:
            break
    return Model(model.good, model.bad, model.unit, max(0.0, float(t[1])), float(t[0]))


def _with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = statistics(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(list(found.astype(np.int32)), pa.int32())], ["doc_id", "x"])

    return rows.mapInArrow(run, "doc_id long, x array<int>")


def _learning(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """x, label, fold of the rows to learn from: those with one label, 0 or 1, and not held out."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    return rows.join(known, "doc_id").select("x", "label", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)).alias("fold"))


def _moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By label: the number of rows, sums and sums of products of their statistics, added up in tasks first."""
    size = len(STATISTICS)
    width = 1 + size + size * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width), np.int64)
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, size).astype(np.int64)
            label = batch.column("label").to_numpy()
            for c in (0, 1):
                own = x[label == c]
                sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), lists(list(sums), pa.int64())], ["label", "sums"])

    parts = rows.select("x", "label").mapInArrow(run, "label int, sums array<long>")
    added = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    out = {c: np.zeros(width) for c in (0, 1)}
    for r in added.toLocalIterator():
        out[r["label"]][r["pos"]] = float(r["s"])
    return {c: (int(v[0]), v[1 : 1 + size], v[1 + size :].reshape(size, size)) for c, v in out.items()}


def _binned(rows: DataFrame, model: Model) -> list[tuple[float, int, int]]:
    """(compressed difference, label, number) of bins; there are a few hundred at most, as differences are compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(STATISTICS)).astype(float)
            bins = np.rint(model.difference(x) / BIN).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("label")], ["bin", "label"])

    counts = rows.select("x", "label").mapInArrow(run, "bin int, label int").groupBy("bin", "label").count()
    return [(r["bin"] * BIN, r["label"], r["count"]) for r in counts.collect()]


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """The model, learned from all labelled rows (doc_id, x) that are not held out."""
    known = common.table(_learning(rows, labels, id_col, label_col), "learning")
    model = densities(_moments(known.where("fold > 0")))
    if model.good is None:  # too few rows to spare a fold
        model = densities(_moments(known))
        return calibrated(model, _binned(known, model))
    return calibrated(model, _binned(known.where("fold = 0"), model))


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1: how likely label 1 is), predicted (1 from ``threshold`` on),
    statistics (see STATISTICS).

    Labels are 0 or 1, by id; other ones, null ones, ids without one, with both, held out or null teach nothing.  Only the
    whole text is read for a score.  A null or blank text has the statistics of no words and a score like any other.
    Without labels of both kinds all texts have one score: a half, or what the labels there are say.  Rows that repeat are
    rows each; other columns are ignored; an empty table gives no rows."""
    rows = common.table(_with_statistics(docs, id_col, text_col), "statistics")
    model = fit(rows, labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(STATISTICS))
            score = model.score(x.astype(float))
            columns = [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), lists(list(x / SCALE), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "statistics"])

    scored = rows.mapInArrow(run, "doc_id long, score double, predicted int, statistics array<double>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "statistics")
