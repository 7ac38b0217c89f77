"""What the operators of this package share: shared storage, size-checked joins, text constants."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.storage import ship

#: The white space that separates words: blank, tab, LF, VT, FF, CR.
WORD_SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode alone, a new local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brackwater-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/brackwater/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: its lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], small_rows: int, max_rows: int = 100_000, how: str = "left", salts: int = 32) -> DataFrame:
    """big joined with the rows of small (one per key, of bounded width; nulls equal nulls). small_rows is small's counted size: up to
    max_rows it is broadcast, beyond that each of its rows is copied to `salts` salts so that a hot key of big is dealt over as many tasks."""
    keys = [f"__bw_k{i}" for i in range(len(on))]
    right = small.withColumnsRenamed(dict(zip(on, keys, strict=True)))
    match = [big[c].eqNullSafe(right[k]) for c, k in zip(on, keys, strict=True)]
    if small_rows <= max_rows:
        return big.join(F.broadcast(right), match, how).drop(*keys)
    left = big.withColumn("__bw_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    right = right.withColumn("__bw_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = [left[c].eqNullSafe(right[k]) for c, k in zip(on, keys, strict=True)]
    return left.join(right, [*match, left["__bw_salt"] == right["__bw_salt_r"]], how).drop(*keys, "__bw_salt", "__bw_salt_r")


def settled(column: Column) -> Column:
    """column, computed once where it stands: the optimizer moves no filter below it and copies it into no other expression."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, UPPER, LOWER)
