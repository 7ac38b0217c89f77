"""Target-distribution importance resampling: documents are drawn by how much likelier the target corpus makes their words than the raw corpus does.

Features are runs of 1 to `most_words` words; a feature's bucket is a hash of it. Postings (bucket, document, count) are shuffled by stripe of buckets (postings.py). There the buckets of the raw
corpus and of the target meet: a bucket's gain, the logarithm of its smoothed share in the target over that in the raw corpus, is worked out where its postings lie,
the postings become contributions of count times gain, and these are summed by document. A document's weight is the mean of its features' gains. Noise by hash of its id makes the highest
scores a draw without replacement in proportion to the weights' exponents (Gumbel's maxima).

Ranks are dealt without a global sort: scores are whole thousandths between about -50,000 and 60,000, so a histogram of them is bounded and names the score from which documents may be drawn; these alone are
range-partitioned by (score, id, row), numbered in their partitions, and offset by the counts of the partitions before.

Defined cases: a null or wordless text has no features, weight 0, and isn't drawn, as are documents of fewer than `least_words` words; a null id is drawn by the hash of '<seed>:' and comes last among ties;
of rows of one id each has its rank, those of one id and score in any order; an empty target or corpus has no counts, which the smoothing allows; an empty table gives no rows; other columns
are not read, whatever their names; very long texts are read whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.llm import postings
from brackwater.llm.common import read, ship, stored

BUCKETS, STRIPES = 10_000, 16
SEED = 2024
LEAST_WORDS, PERCENT = 20, 10
#: Features whose buckets a worker keeps.
CACHED = 500_000
#: What is no word: ASCII but for digits and lower-case letters; A-Z become lower case.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.n
        return bucket


def features(text: bytes | None, most_words: int = 1) -> tuple[int, list[bytes]]:
    """The number of words, and the runs of 1 to most_words of them."""
    words = (text or b"").translate(_WORDS).split()
    return len(words), words + [b" ".join(words[i : i + k]) for k in range(2, most_words + 1) for i in range(len(words) - k + 1)]


def bucketed(docs: DataFrame, key: str = "doc_id", text: str = "text", most_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Two kinds of rows. Of each document: row, doc_id, n_words, n_features. Of each stripe and batch of documents: its postings, packed (see postings.PACKED)."""
    ship(docs.sparkSession)
    width = -(-buckets // STRIPES)
    fields = [f.split() for f in postings.PACKED.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = ["row", "doc_id", "n_words", "n_features", *(f for f, _ in fields)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bucket = TaskContext.get().partitionId() << 31, Buckets(buckets)
        for whole in batches:
            texts, at = whole.column(1), 0
            while at < whole.num_rows:
                start, n, sizes, codes = at, 0, [], []
                while at < whole.num_rows and at - start < postings.DOCS and n < postings.ENTRIES:
                    words, found = features(texts[at].as_py(), most_words)
                    # A bucket's stripe is its remainder, so that neighbours lie apart.
                    codes.append(np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)))
                    sizes.append((words, len(found)))
                    n, at = n + len(found), at + 1
                code = np.concatenate(codes)
                rows = list(postings.packed(code % STRIPES * width + code // STRIPES, np.repeat(np.arange(len(codes)), [len(c) for c in codes]), number, width))
                doc = [pa.array(np.arange(len(sizes)) + number * postings.DOCS), whole.column(0).slice(start, at - start), pa.array([w for w, _ in sizes], pa.int64()), pa.array([f for _, f in sizes], pa.int64())]
                yield pa.RecordBatch.from_arrays([*doc, *(pa.nulls(len(sizes), arrow[t]) for _, t in fields)], names=names)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), d.type) for d in doc), *(pa.array([r[k] for r in rows], arrow[t]) for k, (_, t) in enumerate(fields))], names=names)
                number += 1

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(count, f"row long, doc_id {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, {postings.PACKED}")


def weighted(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", most_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words, n_features, weight of each row of docs."""
    width = -(-buckets // STRIPES)
    raw = stored(bucketed(docs, key, text, most_words, buckets), "postings")
    wanted = stored(bucketed(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), most_words=most_words, buckets=buckets), "target")
    all_raw, all_wanted = (x.agg(F.sum("n_features")).first()[0] or 0 for x in (raw, wanted))
    both = [stored(postings.totals(x.where("stripe IS NOT NULL"), STRIPES, width, lambda df: stored(df, "combined")), "totals") for x in (raw, wanted)]

    def prepare(blocks: list[np.ndarray]) -> np.ndarray:
        s, t = (b.tolist() for b in blocks)
        gain = [math.floor(1000 * math.log((t[i] + 1) * (all_raw + buckets) / ((s[i] + 1) * (all_wanted + buckets)))) for i in range(width)]
        return np.array(gain, np.int64)

    sums = postings.contributions(raw.where("stripe IS NOT NULL"), both, STRIPES, width, prepare, lambda gain, codes: [gain[codes]], ["gains"])
    each = raw.where("stripe IS NULL").select("row", "doc_id", "n_words", "n_features")
    mean = F.expr("(gains - pmod(gains, n_features)) div n_features")  # floors go down
    return each.join(sums, "row", "left").select("row", "doc_id", "n_words", "n_features", F.coalesce(mean, F.lit(0)).cast("long").alias("weight"))


def noisy(seed: int) -> Column:
    """Gumbel noise in thousandths, by hash of doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (row, doc_id, n_words, score, stored) with rank: 1, 2, ... for the highest scores among the documents of least_words words or more, null for the rest."""
    ship(scored.sparkSession)
    spark = scored.sparkSession
    may = scored.where(F.col("n_words") >= least_words)
    counts = {r["score"]: r["count"] for r in may.groupBy("score").count().collect()}  # whole thousandths between the least and the largest gain plus noise
    want, cut, n = percent * sum(counts.values()) // 100, None, 0
    for score in sorted(counts, reverse=True):
        if n >= want:
            break
        cut, n = score, n + counts[score]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.withColumn("rank", none)
    parts = max(1, min(10_000, n // 100_000 + 1, 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fields = scored.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(had + 1, had + 1 + b.num_rows)), pa.array(np.full(b.num_rows, part, np.int32))], names=[*fields, "place", "part"])
            had += b.num_rows

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    high = may.where(F.col("score") >= cut).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(high.mapInArrow(number, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema), "place long", "part int"])), "placed")
    before, offsets = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):  # one for each of the partitions, 10,000 at most
        offsets.append((r["part"], before))
        before += r["count"]
    base = F.broadcast(spark.createDataFrame(offsets, "part int, base long"))
    rank = F.col("place") + F.col("base")
    ranked = placed.join(base, "part").select(*fields, F.when(rank <= want, rank).alias("rank"))
    rest = scored.where((F.col("n_words") < least_words) | (F.col("score") < cut)).select(*fields, none)
    return rest.unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", most_words: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs; rank is null for those that aren't drawn."""
    found = weighted(docs, target, key, text, target_text, most_words, buckets)
    scored = stored(found.withColumn("score", F.col("weight") + noisy(seed)), "scored")
    return drawn(scored, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


_CRC = """
    crc_table AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(i))),
    words_of AS (SELECT DISTINCT w FROM (SELECT unnest(words) AS w FROM texts)),
    hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::BIGINT + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM words_of, crc_table)"""

SQL = {
    "op12_resampling": rf"""
WITH texts AS (SELECT row_number() OVER () AS rn, corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM (SELECT 0 AS corpus, doc_id, text FROM documents UNION ALL SELECT 1, 0, text FROM benchmark)),{_CRC},
    posted AS (SELECT corpus, rn, bucket, count(*) AS n FROM (SELECT corpus, rn, unnest(words) AS w FROM texts) JOIN hashed USING (w) GROUP BY ALL),
    sums AS (SELECT bucket, sum(n) FILTER (corpus = 0) AS s, coalesce(sum(n) FILTER (corpus = 1), 0) AS t FROM posted GROUP BY bucket),
    whole AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM (SELECT coalesce(s, 0) AS s, t FROM sums)),
    gains AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (all_s::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (all_t::DOUBLE + 10000))))::BIGINT AS gain FROM sums, whole),
    weights AS (SELECT rn, sum(n) AS n, sum(n * gain) AS g FROM posted JOIN gains USING (bucket) WHERE corpus = 0 GROUP BY rn),
    scored AS (SELECT rn, doc_id, len(words) AS n_features, coalesce(((g - ((g % n) + n) % n) // n)::BIGINT, 0) AS weight,
            floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
        FROM texts LEFT JOIN weights USING (rn) WHERE corpus = 0),
    ranked AS (SELECT rn, row_number() OVER (ORDER BY weight + noise DESC, doc_id, rn) AS r, count(*) OVER () AS of FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, weight + noise AS score, CASE WHEN r <= 10 * of // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (rn)"""
}


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
