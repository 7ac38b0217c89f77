"""Trace snapshots as a stream. A process rewrites its cumulative snapshot, so what counts is the last one of each process, added up over
processes; adding up all that arrive would count calls twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brackwater.store import BucketStore, bucket_of

#: Buckets of a stream's state, by process and environment.
BUCKETS = 64
STATE = "env string, pid long, qual string, flushed long, hits long"


def last_snapshots(rows: DataFrame) -> DataFrame:
    """env, qual, hits: batch form. rows: env, pid, qual, hits, flushed."""
    last = rows.groupBy("env", "pid", "qual").agg(F.max_by("hits", "flushed").alias("hits"))
    return last.groupBy("env", "qual").agg(F.sum("hits").alias("hits"))


def start(rows: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The same over a stream: the last snapshot of each process in the memory table `name`; sum it over pid to read."""
    last = rows.groupBy("env", "pid", "qual").agg(F.max_by("hits", "flushed").alias("hits"))
    return last.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_upserts(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The last snapshots as a Parquet table that each micro-batch rewrites beside the one before: path/v=<batch>."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("env", "pid", "qual").agg(F.max(F.struct("flushed", "hits")).alias("s"))
        if number:
            new = new.unionByName(spark.read.parquet(f"{path}/v={number - 1}").select("env", "pid", "qual", F.struct("flushed", "hits").alias("s")))
        new.groupBy("env", "pid", "qual").agg(F.max("s").alias("s")).select("env", "pid", "qual", "s.*").write.mode("overwrite").parquet(f"{path}/v={number}")

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_state(rows: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS, keep: int = 2) -> StreamingQuery:
    """Keyed state in a BucketStore at `root`: the last snapshot of each (env, pid, qual), in buckets of (env, pid). A micro-batch reads and writes the buckets of its own processes only; what it doesn't touch stays where it
    is, and the last `keep` states can be read. Snapshots that come late or again change nothing, for the latest flush counts (of equal ones, the larger count), and a batch that is run again is known by its number."""

    def merge(batch: DataFrame, number: int) -> None:
        store = BucketStore(batch.sparkSession, root)
        if store.manifest()[2].get("batch", -1) >= number:
            return
        key = F.concat_ws("|", "env", F.col("pid").cast("string"))
        new = batch.select("env", F.col("pid").cast("long").alias("pid"), "qual", F.col("flushed").cast("long").alias("flushed"), F.col("hits").cast("long").alias("hits")).withColumn("bucket", bucket_of(key, buckets))
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # as many as there are buckets
        both = store.read("state", STATE, touched).unionByName(new)
        last = both.groupBy("bucket", "env", "pid", "qual").agg(F.max(F.struct("flushed", "hits")).alias("s")).select("env", "pid", "qual", "s.*", "bucket")
        store.commit({"state": (last, touched)}, {"batch": number}, {"state": ["env", "pid", "qual"]})
        store.vacuum(keep)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, root: str) -> DataFrame:
    """env, pid, qual, flushed, hits: the last state that was written whole."""
    return BucketStore(spark, root).read("state", STATE).drop("bucket")


def state_totals(spark: SparkSession, root: str) -> DataFrame:
    """env, qual, hits: what last_snapshots() makes of all rows that have arrived."""
    return state(spark, root).groupBy("env", "qual").agg(F.sum("hits").alias("hits"))
