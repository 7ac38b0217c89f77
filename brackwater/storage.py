"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each application, unless PYTHONPATH, which they inherit, has it."""
    top, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _shipped or str(top) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="brackwater-")) / "brackwater.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((top / "brackwater").rglob("*.py")):
            z.write(f, f.relative_to(top))
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode alone, a new local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brackwater-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/brackwater/{spark.sparkContext.applicationId}"


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files of a table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.md5(repr(sorted(found)).encode()).hexdigest()


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """df, written as Parquet under spark.checkpoint.dir and read back, so that loops don't grow their lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
