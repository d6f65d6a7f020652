"""The registered queries of this package, one for each operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finished, read
from .fingerprints import fingerprints
from .hard_negatives import hard_negatives
from .language_id import language_id
from .licenses import license_scan
from .licenses import oracle as license_oracle
from .mixing import mix
from .mixing import oracle as mixing_oracle
from .ngram_jaccard import ngram_jaccard
from .packing import best_fit_packing
from .periodic_runs import periodic_runs, with_planted_runs
from .quality import quality
from .sharding import shard
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .topk_search import quantised, topk_inner_product


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(read(spark, sf_dir, "documents"), k=4, percent=85)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), shards=16)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read(spark, sf_dir, "documents"), vocabulary())


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_inner_product(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths: source, language and two levels of ids stand for them; short texts are NOTICE files."""
    docs = read(spark, sf_dir, "documents")
    i = docs["doc_id"].cast("string")
    name = F.when(F.length(docs["text"]) < 400, F.concat(F.lit("NOTICE-"), i)).otherwise(F.concat(i, F.lit(".txt")))
    path = F.concat_ws("/", docs["source"], docs["lang"], F.expr("doc_id div 500").cast("string"), F.expr("doc_id div 50").cast("string"), name)
    return license_scan(docs, path)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), vocabulary())


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).drop("kept_text", "repeats")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("statistics")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", shifted)
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"), positives=5, negatives=5, low=80, high=100)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    docs = docs.withColumn("text", with_planted_runs(docs["text"], docs["doc_id"]))
    return periodic_runs(docs).drop("runs", "collapsed_text")


def _tidy(name: str, query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with its result as a table; the tables on the way to it are removed."""
    return lambda spark, sf_dir: finished(lambda: query(spark, sf_dir), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _tidy(k, v) for k, v in globals().items() if k.startswith("op") and callable(v)}


OP1_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(CASE WHEN len(w) >= 4 THEN array_to_string(w[i:i + 3], ' ') ELSE array_to_string(w, ' ') END) AS shingle
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

OP10_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(generate_series(0, 49)) AS k FROM win JOIN first USING (h) WHERE doc_id > first)),
pos AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM w)),
kept AS (SELECT pos.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS kept FROM pos LEFT JOIN gone USING (doc_id, p) GROUP BY pos.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_inner_product(a.v, x.v)::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id % 100 = 0 AND x.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""

# crc32 by a table of its 256 steps; runs are stretches of places whose next three words recur q words on.
OP13_SQL = """
WITH RECURSIVE step(n, c, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i + 1 FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE i = 8),
given AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
hashed AS (SELECT doc_id, w, len(w) AS n, xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: xor(c // 256, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) AS h FROM given, crc),
planted AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS change, CASE WHEN n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM hashed),
words AS (SELECT doc_id, CASE WHEN change THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w, n FROM planted),
place AS (SELECT doc_id, n, i, md5(array_to_string(w[i + 1:i + 3], ' ')) AS k FROM (SELECT doc_id, n, w, unnest(range(n - 2)) AS i FROM words WHERE n >= 6)),
pair AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM place a JOIN place b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair) GROUP BY doc_id, q, island),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM run GROUP BY doc_id),
best AS (SELECT doc_id, start, length, period FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY -length::DOUBLE / period, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, sha256(coalesce(string_agg(word, ' ' ORDER BY i), '')) AS s FROM
  (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words WHERE doc_id IN (SELECT doc_id FROM run)) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT words.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(s, sha256(array_to_string(w, ' '))) AS collapsed_sha256
FROM words LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """What SQL expresses; the others are tested against brute force."""
    return {
        "op1_ngram_jaccard": OP1_SQL,
        "op3_mixing": mixing_oracle(),
        "op5_topk_search": OP5_SQL,
        "op7_license_scan": license_oracle(),
        "op10_substring_dedup": OP10_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_periodic_runs": OP13_SQL,
    }
