"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol a byte, linked to its neighbours.  A heap has each adjacent pair's rank; the pair of the
lowest rank (leftmost first) is popped, merged, and its two new neighbours are pushed.  A pre-token's tokens are its
initial symbols less its merges: no identifiers are looked up.  Counts of pre-tokens are kept by each worker.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import sliced
from .pretoken import Kept, fits, latin


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class HeapMerger:
    """Counts a pre-token's tokens under ranked merges."""

    def __init__(self, merges: list, suffix: str = ""):
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in merges)
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols, self.suffix = byte_symbols(), suffix

    def count(self, token: bytes) -> int:
        """The number of tokens of one pre-token's bytes."""
        symbols = [self.symbols[b] for b in token]
        if not symbols:
            return 0
        symbols[-1] += self.suffix
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i in range(n - 1) if (r := ranks.get(p := (symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair[0] + pair[1], None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(p := (symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := ranks.get(p := (symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, p))
        return n - merges


class Counter:
    """Counts a text's tokens as the library of a vocabulary file does, special strings included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merger = HeapMerger(model["merges"], model.get("end_of_word_suffix") or "")
        library, back = Tokenizer.from_file(path), {s: b for b, s in enumerate(merger.symbols)}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.fast, self.special = fits(spec), set(special)
        self.plain = Kept(lambda t: merger.count(t.encode()))
        self.coded = Kept(lambda t: merger.count(bytes(back[c] for c in t)), 50_000)
        self.library = library

    def _run(self, text: str) -> int:
        pieces = latin(text) if self.fast else None
        if pieces is not None:
            return sum(map(self.plain.__getitem__, pieces))
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return sum(self.coded[p] for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))

    def count(self, text: str) -> int:
        if self.cut is None or not self.cut.search(text):
            return self._run(text)
        return sum(1 if part in self.special else self._run(part) for part in self.cut.split(text) if part)


class SentenceCounter:
    """The same for a sentencepiece model, whose merges are the library's."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter | SentenceCounter:
    """One of each vocabulary for a worker process."""
    return SentenceCounter(path) if path.endswith(".model") else Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a vocabulary file that every executor has.  A null text counts as empty: 0 bytes, 0 tokens.  Repeated
    rows and null ids are kept as they are; other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in sliced(batches):
            tokens = [count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"),
        docs[text_col].cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
