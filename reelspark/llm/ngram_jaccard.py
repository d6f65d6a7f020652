"""N-gram Jaccard join by parity sketches.

Every document is its set of word shingles.  Two sets link when their Jaccard similarity reaches a threshold, so their
symmetric difference is at most a known share of their sizes.  Each shingle's hash is XORed into one word of a sketch
and flips one bit of a bit sketch; a shingle that only one set has changes at most one word and one bit, so the number of
words (bits) that differ is a lower bound of the symmetric difference.

1. Sets fall into size bands.  A band fixes the number of sketch words, about half as many again as the largest
   difference allowed, so (pigeonhole) linked sets have more equal words than either may leave out.  Each set emits as
   many words as it may differ in, plus one, those that hold the most shingles first; two linked sets then share an
   emitted word.
2. Emitted words are counted, and those of more than one set joined.  Of the sets under a word one is the leader, the one
   with the most shared words; each set is compared with the leader it shares most words with.
3. Candidates whose sizes or bit sketches show too large a difference are dropped; the rest are verified on the sets.
4. Links give components.  Where sets of different components remain under a word, each such pair of like sizes is held
   against its bit sketches, in tiles of bounded size, and what passes is verified too.  So every pair of sets under a
   word is linked through others or has been compared.

Equal sets are one class from the start, and copies are never expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .kernels import U64, Words, chunks, lists, mix, signed, sliced, utf8

#: Sizes of band i: from FIRST * RATIO**i on, below FIRST * RATIO**(i+1).
FIRST, RATIO = 4, 4
#: The least number of bits of the sketch that candidates are held against; larger sets have at least a bit a shingle.
SKETCH_BITS = 1024
#: Sets of one word that meet in a task, on either side; followers that meet a copy of their leader's set in a task.
TILE, FOLLOWERS = 512, 128


def _difference(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (100 - percent) * (a + b) // (100 + percent)


def _schemes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, sketch words of the band, words that a set of n shingles emits) for each band that n takes part in."""
    band, low = 0, FIRST
    while n >= low * RATIO:
        band, low = band + 1, low * RATIO

    def words(high: int) -> int:
        return 3 * (_difference(high - 1, 100 * (high - 1) // percent, percent) + 1) // 2 + 1

    out = [(band, words(low * RATIO), _difference(n, 100 * n // percent, percent) + 1)]
    if band and percent * n <= 100 * (low - 1):  # as the larger of a pair whose smaller is in the band below
        out.append((band - 1, words(low), _difference(n, low - 1, percent) + 1))
    return out


def _emitted(u: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the sketch words that the sorted set of shingle hashes emits."""
    keys = []
    spread = mix(u, 5)
    for band, k, emit in _schemes(len(u), percent):
        block = ((u >> U64(32)) * U64(k)) >> U64(32)  # rises with u
        cut = np.flatnonzero(np.diff(block, prepend=U64(2**63)))
        content, held = np.zeros(k, U64), np.zeros(k, np.int64)
        at = block[cut].astype(np.int64)
        content[at] = np.bitwise_xor.reduceat(spread, cut)
        held[at] = np.diff(np.append(cut, len(u)))
        rank = (np.minimum(held, 255).astype(U64) << U64(56)) | (content >> U64(8))
        top = np.argpartition(rank, k - emit)[k - emit :] if emit < k else np.arange(k)
        keys.append(mix(content[top] ^ mix(top.astype(U64), 1000 + band)))
    return np.concatenate(keys)


def _bits(u: np.ndarray) -> np.ndarray:
    """The bit sketch of a set: a power of two of bits, at least SKETCH_BITS and at least one a shingle.

    The sketch of half the width is the XOR of its halves."""
    width = max(SKETCH_BITS, 1 << max(0, len(u) - 1).bit_length())
    parity = np.bincount((u % U64(width)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64)


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's sorted set of shingle hashes."""
    for a, b in chunks(texts):
        words = Words(texts[a:b], lower=True)
        grams, whole = words.grams(k), words.whole()
        for i, (p, q) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
            yield np.unique(grams[p : q - k + 1]) if q - p >= k else whole[i : i + (q > p)]


def _class(u: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set."""
    size = U64(len(u))
    return tuple(int(mix(np.array([mix(u, s).sum(dtype=U64) ^ size]))[0]) for s in (21, 22))


def _classes_of(sets: list[np.ndarray], width: int) -> list[pa.Array]:
    """Columns c and c2 of some sets, c of ``width`` bits."""
    c = np.array([_class(u) for u in sets], U64).reshape(len(sets), 2)
    c[:, 0] >>= U64(64 - width)
    return [pa.array(signed(c[:, i])) for i in (0, 1)]


def sketches(docs: DataFrame, k: int, percent: int, width: int = 64) -> DataFrame:
    """doc_id, n (set size), c and c2 (hashes of the set), keys (emitted sketch words), bits (the bit sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = list(_sets(utf8(batch.column("text")), k))
            if not sets:
                continue
            keys = [signed(_emitted(u, percent)) if len(u) else np.zeros(0, np.int64) for u in sets]
            n = pa.array([len(u) for u in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n, *_classes_of(sets, width), lists(keys, pa.int64()), lists([_bits(u) for u in sets], pa.int64())],
                ["doc_id", "n", "c", "c2", "keys", "bits"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, c long, c2 long, keys array<long>, bits array<long>")


def shingle_sets(docs: DataFrame, k: int, width: int = 64) -> DataFrame:
    """The other columns of ``docs`` (longs), c2 and c (hashes of the set), and the set itself, of each text."""
    kept = [x for x in docs.columns if x != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = list(_sets(utf8(batch.column("text")), k))
            if sets:
                columns = [*(batch.column(x) for x in kept), *_classes_of(sets, width), lists([signed(u) for u in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "c", "c2", "shingles"])

    return docs.mapInArrow(run, ", ".join(f"{x} long" for x in [*kept, "c", "c2"]) + ", shingles array<long>")


def _named(sets: DataFrame, clashing: DataFrame | None) -> DataFrame:
    """Rows with (c, c2) under one name c for each pair: c itself unless it is in ``clashing``, the c of several c2."""
    if clashing is None:
        return sets.drop("c2")
    both = sets.join(clashing.select(F.col("c").alias("_c")), F.col("c") == F.col("_c"), "left")
    return both.withColumn("c", F.when(F.col("_c").isNull(), F.col("c")).otherwise(F.xxhash64("c", "c2"))).drop("_c", "c2")


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether the sizes allow a link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _links(sets: Callable[[DataFrame], DataFrame], classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame | None:
    """Of the distinct pairs of classes (c, l), those whose sets link, as a written table (u, v); None if there are none.

    ``sets`` gives the sets of wanted classes.  Pairs that the bit sketches allow are dealt by l, FOLLOWERS to a group, so
    that a set is shuffled once for each pair and once for each group that it leads."""
    side = lambda x: classes.select(*[F.col(y).alias(f"{y}_{x}") for y in ("c", "n", "bits", "rep")])
    shorter = F.least(F.size("bits_c"), F.size("bits_l"))
    folded = lambda b: F.when(
        F.size(b) > shorter, F.zip_with(F.slice(b, F.lit(1), shorter), F.slice(b, shorter + 1, shorter), lambda x, y: x.bitwiseXOR(y))
    ).otherwise(F.col(b))
    differ = F.aggregate(
        F.zip_with(folded("bits_c"), folded("bits_l"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    allowed = F.floor((100 - percent) * (F.col("n_c") + F.col("n_l")) / (100 + percent))
    near = pairs.join(side("c"), F.col("c") == F.col("c_c")).join(side("l"), F.col("l") == F.col("c_l"))
    near = near.where(_alike("n_c", "n_l", percent)).where(differ <= allowed).select("c", "l", "rep_c", "rep_l")
    near = common.table(near, "near")
    groups = near.groupBy("l", "rep_l").agg(F.ceil(F.count("*") / FOLLOWERS).alias("groups"))
    groups = common.table(groups, "groups")
    if groups.isEmpty():
        return None
    dealt = near.join(groups.select("l", "groups"), "l").withColumn("part", F.pmod(F.xxhash64("c"), "groups"))
    follow = common.table(dealt.select(F.col("rep_c").alias("doc_id"), F.col("c").alias("own"), "l", "part"), "follow")
    lead = groups.select(F.col("rep_l").alias("doc_id"), F.col("l").alias("own"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    lead = common.table(lead.select("doc_id", "own", F.col("part").cast("long").alias("part")), "lead")
    other = sets(lead).select(F.col("own").alias("l"), "part", F.col("shingles").alias("other"))
    both = sets(follow).join(other, ["l", "part"])
    same = F.size(F.array_intersect("shingles", "other"))
    linked = both.where(100 * same >= percent * (F.size("shingles") + F.size("other") - same))
    out = common.table(linked.select(F.col("own").alias("u"), F.col("l").alias("v")), "links")
    common.drop(near, groups, follow, lead)
    return out


def _apart(words: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (c, l) of classes under one key (key, c, n, root), of different roots, that sizes and bit sketches allow to
    link; a written table.

    Sizes are cut into steps of the least ratio of linked sets, so that a set meets its own step and the next.  Steps of
    the same members are taken once.  A step of two gives its pair; the members of a larger one are dealt into blocks of
    TILE, each two blocks meet in one task, and only what passes the sketches leaves it as rows."""
    mixed = words.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    mixed = common.table(mixed, "mixed")
    step = F.floor(F.log(F.col("n").cast("double")) / (1.000001 * math.log(100 / percent))).cast("int")
    rows = words.join(mixed, "key").withColumn("own", step).withColumn("step", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    rows = common.table(rows.select("key", "step", (F.col("own") == F.col("step")).alias("low"), "c", "n", "root"), "steps")
    hashed = F.xxhash64("c", "low")
    steps = rows.groupBy("key", "step").agg(
        F.min("root").alias("lo"),
        F.max("root").alias("hi"),
        F.max("low").alias("any"),
        F.count("*").alias("held"),
        F.min(F.struct("c", "n")).alias("a"),
        F.max(F.struct("c", "n")).alias("b"),
        F.bit_xor(hashed).alias("m1"),
        F.bit_xor(F.xxhash64(hashed)).alias("m2"),
    )
    # two steps of the same members have the same pairs, whatever their keys
    steps = steps.where("lo <> hi and any").groupBy("held", "m1", "m2").agg(F.min(F.struct("key", "step", "a", "b")).alias("s"))
    steps = common.table(steps.select("held", "s.*"), "stepped")
    two = steps.where("held = 2").select(F.col("a.c").alias("c"), F.col("b.c").alias("l"), F.col("a.n").alias("n_c"), F.col("b.n").alias("n_l"))
    two = two.where(_alike("n_c", "n_l", percent)).select("c", "l")
    blocks = F.ceil(F.col("held") / TILE).cast("int")
    tiled = rows.join(steps.where("held > 2").select("key", "step", blocks.alias("blocks")), ["key", "step"])
    tiled = tiled.join(classes.select("c", "bits"), "c").withColumn("b", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    tiled = tiled.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("key", "step", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "b", "low", "c", "root", "n", "bits")
    tiles = tiled.repartition("key", "step", "i", "j").sortWithinPartitions("key", "step", "i", "j", "c")
    out = common.table(two.union(tiles.mapInArrow(_tile_pairs(percent), "c long, l long")).distinct(), "apart")
    common.drop(mixed, rows, steps)
    return out


def _tile_pairs(percent: int):
    names = ("key", "step", "i", "j", "b", "low", "c", "root", "n")

    def close(t: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the rows ``one`` and ``two`` that roots, steps, sizes and sketches allow."""
        for at in range(0, len(one), 64):
            a = one[at : at + 64]
            na, nb = t["n"][a][:, None], t["n"][two][None]
            ok = (t["root"][a][:, None] != t["root"][two][None]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            ok &= t["low"][a][:, None] | t["low"][two][None]
            if same:
                ok &= a[:, None] < two[None]
            x, y = np.nonzero(ok)
            u, v = a[x], two[y]
            width = np.minimum(t["width"][u], t["width"][v])
            for w in np.unique(width).tolist():
                p, q = u[width == w], v[width == w]
                rows, index = np.unique(np.concatenate([p, q]), return_inverse=True)
                bits = np.stack([s if len(s) == w else s[:w] ^ s[w:] for s in t["bits"][rows]])
                left, right = index[: len(p)], index[len(p) :]
                for cut in range(0, len(p), step := max(1, (1 << 20) // w)):
                    part = slice(cut, cut + step)
                    differ = np.bitwise_count(bits[left[part]] ^ bits[right[part]]).sum(1, dtype=np.int64)
                    near = differ <= (100 - percent) * (t["n"][p[part]] + t["n"][q[part]]) // (100 + percent)
                    yield t["c"][p[part][near]], t["c"][q[part][near]]

    def tile(t: dict[str, np.ndarray], p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, j = t["i"][p], t["j"][p]
        one, two = (p + np.flatnonzero(t["b"][p:q] == x) for x in (i, j))
        yield from close(t, one, two, i == j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def flush(t: dict[str, np.ndarray], last: bool) -> tuple[pa.RecordBatch | None, dict | None]:
            differs = np.any([np.diff(t[x]) != 0 for x in ("key", "step", "i", "j")], axis=0)
            cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), len(t["key"])]
            done = cuts if last else cuts[:-1]
            found = [x for p, q in zip(done[:-1], done[1:]) for x in tile(t, p, q)]
            rest = None if last else {k: v[done[-1] :] for k, v in t.items()}
            if not found:
                return None, rest
            c, l_ = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(l_)], ["c", "l"]), rest

        for batch in batches:
            if not batch.num_rows:
                continue
            t = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            bits = batch.column("bits")
            offsets, flat = bits.offsets.to_numpy(), np.array(bits.values).view(U64)  # bits of signed numbers are counted of their absolute value
            t["width"] = np.diff(offsets)
            t["bits"] = np.empty(batch.num_rows, object)
            for i, (p, q) in enumerate(zip(offsets[:-1], offsets[1:])):
                t["bits"][i] = flat[p:q]
            t = t if held is None else {k: np.concatenate([held[k], t[k]]) for k in t}
            out, held = flush(t, False)
            if out is not None:
                yield out
        if held is not None:
            out, _ = flush(held, True)
            if out is not None:
                yield out

    return run


def similar_classes(docs: DataFrame, k: int, percent: int, width: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """(members, roots): members has doc_id, n, c (the class of equal sets); roots has node (a linked class), root.

    ``width`` is the number of bits of the hash that names a class; sets it confuses are told apart by another."""
    rows = common.table(sketches(docs, k, percent, width).withColumn("row", F.monotonically_increasing_id()), "sketches")
    kinds = rows.where("n > 0").groupBy("c", "c2").agg(
        F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits")
    )
    kinds = common.table(kinds, "kinds")
    # different sets of equal c: one in 2**64 pairs
    clashing = common.table(kinds.groupBy("c").agg(F.count("*").alias("m")).where("m > 1").select("c"), "clashing")
    clashing = None if clashing.isEmpty() else clashing
    sets = lambda wanted: _named(shingle_sets(common.pick(docs, wanted, "doc_id"), k, width), clashing).where("c = own")
    classes = _named(kinds, clashing)
    named = _named(rows.select("row", "doc_id", "n", "c", "c2"), clashing)
    copies = named.join(classes.select(F.col("c").alias("_c"), F.col("row").alias("_row")), (F.col("c") == F.col("_c")) & (F.col("row") != F.col("_row")))
    copies = common.table(copies.select("row"), "copies")

    once = common.pick(_named(rows.select("row", "c", "c2", "keys"), clashing), copies, "row", "left_anti")
    words = once.select(F.explode("keys").alias("key"), "c")
    shared = common.table(words.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "shared")
    open_ = common.table(words.join(shared, "key"), "words")
    weight = open_.groupBy("c").agg(F.sum("held").alias("weight")).join(classes.select("c", "n"), "c")
    words = common.table(open_.drop("held").join(weight, "c").select("key", "c", "n", "weight"), "weighted")
    common.drop(shared, open_, copies)

    leader = words.groupBy("key").agg(F.max(F.struct("weight", "c", "n")).alias("top"))
    leader = common.table(leader.select("key", F.col("top.c").alias("l"), F.col("top.n").alias("n_l")), "leaders")
    met = words.join(leader, "key").where("c <> l").where(_alike("n", "n_l", percent))
    met = met.groupBy("c", "l").agg(F.count("*").alias("shared")).groupBy("c").agg(F.max(F.struct("shared", "l")).alias("best"))
    links = _links(sets, classes, met.select("c", F.col("best.l").alias("l")), percent)
    common.drop(leader)
    roots = None if links is None else common.table(common.components(links), "roots")
    if roots is None:
        labelled = words.withColumn("root", F.col("c"))
    else:
        labelled = words.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    labelled = common.table(labelled.select("key", "c", "n", "root"), "labelled")
    common.drop(words)
    apart = _apart(labelled, classes, percent)
    more = _links(sets, classes, apart, percent)
    if more is not None:
        edges = more if roots is None else roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)
        roots = common.table(common.components(edges), "roots")
    members = common.table(named.drop("row"), "members")
    common.drop(rows, kinds, labelled, apart)
    return members, roots


def ngram_jaccard(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", width: int = 64
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (size of its set of k-word shingles), component_id.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.  A text with fewer than k words is one
    shingle.  Rows link when 100 * |intersection| >= percent * |union|; component_id is the smallest doc_id that links
    reach.  A null or blank text has an empty set and stands alone.  A null doc_id counts as the smallest id and is
    given back as null.  Repeated rows are one class.  Other columns are ignored; an empty table gives no rows."""
    docs = common.keyed(docs, id_col, text_col)
    members, roots = similar_classes(docs, k, percent, width)
    joined = members.groupBy("c").agg(F.min("doc_id").alias("rep"))
    if roots is None:
        named = joined.withColumnRenamed("rep", "component_id")
    else:
        joined = joined.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        lowest = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = joined.join(lowest, "root").select("c", "component_id")
    return members.join(named, "c").select(
        common.shown(F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        common.shown(F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
    )
