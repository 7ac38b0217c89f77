"""Two-pass external shuffle.

Pass 1 scatters records into memory-sized buckets by a seeded hash, one shuffle partition for each bucket; pass 2 shuffles each bucket (Fisher-Yates) in one
task. The buckets, end to end, are a uniform permutation of the whole table, which is cut into shards of equal length: the row counts of any two shards
differ by one at most (law `rows`) and slots have no gaps. A bucket lies in one shard or in a few neighbouring ones, so write_shards() writes
each bucket's part from where it was shuffled, without a third pass.

Defined cases: a null text has no bytes; rows of one id stay separate rows; identical rows are interchangeable, and when they
overfill a bucket they are scattered by a salt instead of by their key (salted rows are stored, so that counts and rows agree); an empty table gives no rows; other columns pass
through, but for columns named shard or slot, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.llm.common import lookup_join, read, ship, stored

SHARDS = 16
SEED = 20_240_607
#: UTF-8 bytes of text that a bucket holds on average, so that a task can hold and permute it in memory.
BUCKET_BYTES = 24 << 20
#: Buckets there are at least, so that small tables are shuffled in parallel too.
LEAST_BUCKETS = 16


def _fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    order = np.arange(n)
    np.random.default_rng([seed, bucket]).shuffle(order)  # Fisher-Yates, in C
    return order


def external_shuffle(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with shard (int, 0 to shards - 1) and slot (long, the row's place in its shard)."""
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = df.select(
        F.struct(*kept).alias("row"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("bytes"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"),
    )
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / bucket_bytes))
    scattered = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("long"))
    sizes = scattered.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()  # a row for each memory-sized bucket
    over = [r["bucket"] for r in sizes if r["b"] > 4 * max(bucket_bytes, total / buckets)]
    if over:
        # One key fills such a bucket. Its rows are the same but for what is not hashed; a salt scatters them.
        hot = scattered.where(F.col("bucket").isin(over)).groupBy("h").agg(F.sum("bytes").alias("b")).where(F.col("b") > bucket_bytes / 4).select("h", F.lit(True).alias("hot"))
        scattered = lookup_join(scattered, hot, ["h"], hot.count()).withColumn(
            "bucket", F.when(F.col("hot"), F.pmod(F.xxhash64("h", F.monotonically_increasing_id()), F.lit(buckets)).cast("long")).otherwise(F.col("bucket"))
        ).drop("hot")
        scattered = stored(scattered, "scattered")
        sizes = scattered.groupBy("bucket").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in sizes:
        counts[r["bucket"]] = r["n"]
    starts = df.sparkSession.sparkContext.broadcast(np.concatenate([[0], np.cumsum(counts)[:-1]]))  # 8 bytes a bucket
    low, longer = divmod(int(counts.sum()), shards)  # so many shards have a row more than the others

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]  # of one bucket
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        bucket = table["bucket"][0].as_py()
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("h", "ascending"), ("bytes", "ascending"), ("row_hash", "ascending")]))
        order = _fisher_yates(table.num_rows, seed, bucket)
        place = int(starts.value[bucket]) + np.arange(len(order))
        late = place >= longer * (low + 1)
        shard = np.where(late, longer + (place - longer * (low + 1)) // max(1, low), place // (low + 1))
        slot = place - shard * low - np.minimum(shard, longer)
        out = pa.table([table["row"].take(pa.array(order)), pa.array(shard.astype(np.int32)), pa.array(slot)], names=["row", "shard", "slot"])
        yield from out.combine_chunks().to_batches()

    ship(df.sparkSession)
    hashable = [c for c, kind in df.select(*kept).dtypes if "map<" not in kind and "variant" not in kind]
    out = scattered.withColumn("row_hash", F.xxhash64(*[F.col("row").getField(c) for c in hashable])).repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(
        shuffled, T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    )
    return out.select("row.*", "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Each shard as a folder shard=N of files, each in slot order and of slots that no other file lies between; df comes from external_shuffle()."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = external_shuffle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
