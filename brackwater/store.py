"""Tables in buckets that are replaced one by one, with a manifest that switches from one whole state to the next.

    <root>/<table>/of_version=<version>/bucket=<bucket>/*.parquet
    <root>/manifest/of_version=<version>/        table, bucket, version, stats (JSON, in one row without a table)

A commit writes the buckets that change beside the ones that are there, and then a manifest that says in which version each bucket lies. Spark marks a finished
directory with _SUCCESS, so a reader sees the last state that was written whole, or the one before it while a newer one is being written; what a broken commit leaves behind is overwritten
by the next one. There is one writer at a time. vacuum() removes versions that the last `keep` manifests don't name.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A manifest has a row for each bucket of each table, this many at most.
MOST_ROWS = 1_000_000
#: Rows of a bucket's file; a larger bucket has several files.
FILE_ROWS = 2_000_000
#: Files that a task writes at once. Rows come to it in order of their buckets, so that it needn't sort them once more by these.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
MOST_WRITERS = 16


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key; nulls lie in the first."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets)), F.lit(0)).cast("int")


class BucketStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._known: dict[int, tuple] = {}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Versions that were written whole, in order."""
        found = sorted(int(x.removeprefix("of_version=")) for x in self._names(f"{self.root}/manifest") if x.startswith("of_version="))
        return [v for v in found if self._exists(f"{self.root}/manifest/of_version={v}/_SUCCESS")]

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, dict[int, int]], dict]:
        """The version (0 if there is none), the version of each bucket of each table, and the stats that came with it."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, {}, {}
        if version in self._known:
            return self._known[version]
        placed: dict[str, dict[int, int]] = {}
        stats: dict = {}
        for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/of_version={version}").limit(MOST_ROWS).collect():  # a row for each bucket
            if r["table"] is None:
                stats = json.loads(r["stats"])
            else:
                placed.setdefault(r["table"], {})[r["bucket"]] = r["version"]
        self._known = {version: (version, placed, stats)}
        return self._known[version]

    def read(self, table: str, schema: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows of a table, with their bucket; only the directories of the named buckets are opened."""
        _, placed, _ = self.manifest(version)
        there = placed.get(table, {})
        return self._opened(table, schema, there if buckets is None else {b: there[b] for b in set(buckets) & set(there)})

    def _opened(self, table: str, schema: str, placed: Mapping[int, int]) -> DataFrame:
        schema = f"{schema}, bucket int"
        if not placed:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/of_version={v}/bucket={b}" for b, v in sorted(placed.items())]).drop("of_version")

    def commit(
        self, changes: Mapping[str, tuple | Callable[[dict[str, DataFrame]], tuple]], stats: Mapping | Callable[[dict[str, DataFrame]], Mapping] | None = None, sort: Mapping[str, list[str]] | None = None,
        salts: Mapping[str, str] | None = None, made: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, schemas: Mapping[str, str] | None = None,
    ) -> int:
        """Replaces the named buckets of tables by the rows given for them (with a column bucket; a bucket without rows goes), and returns the new version. A change is a table's rows, buckets and, if they are known, the sizes of its buckets in rows, or in what weighs as much;
        it may be a function of what was written of the tables before it. sort: columns by which a table's files are ordered. salts: a column whose values lie in one file each. made: what turns a table's rows, when they were dealt over tasks (in order, with bucket and __salt), into those
        that are written. stats may be a function of what was written, of the tables that schemas names."""
        latest, there, old = self.manifest()
        placed = {t: dict(x) for t, x in there.items()}
        version = max([latest, *(int(x.removeprefix("of_version=")) for x in self._names(f"{self.root}/manifest"))]) + 1
        new: dict[str, DataFrame] = {}
        for table, change in changes.items():
            rows, touched, *known = change(new) if callable(change) else change
            touched = set(touched)
            path = f"{self.root}/{table}/of_version={version}"
            if touched:
                known = known[0] if known else {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # as many as there are buckets
                files = 1 + max(known.values(), default=0) // FILE_ROWS
                by = (salts or {}).get(table)
                salt = F.pmod(F.xxhash64(by) if by else F.monotonically_increasing_id(), F.lit(files))
                order = [F.col(c) for c in ["bucket", "__salt", *(sort or {}).get(table, [])]]
                dealt = rows.withColumn("__salt", salt).repartition(max(1, min(len(known) * files, 10_000)), "bucket", "__salt").sortWithinPartitions(*order)
                if table in (made or {}):
                    dealt = made[table](dealt)
                before = self.spark.conf.get(WRITERS)
                self.spark.conf.set(WRITERS, MOST_WRITERS)
                try:
                    dealt.drop("__salt").write.mode("overwrite").partitionBy("bucket").parquet(path)
                finally:
                    self.spark.conf.set(WRITERS, before)
            now = {int(x.removeprefix("bucket=")) for x in self._names(path) if x.startswith("bucket=")} if touched else set()
            if now - touched:
                raise ValueError(f"rows of {table} lie in buckets that are not replaced: {sorted(now - touched)[:5]}")
            kept = {b: v for b, v in placed.get(table, {}).items() if b not in touched}
            placed[table] = {**kept, **dict.fromkeys(now, version)}
            if table in (schemas or {}):
                new[table] = self._opened(table, schemas[table], dict.fromkeys(now, version))
        if callable(stats):
            stats = stats(new)
        listed = [(t, b, v, None) for t, there in placed.items() for b, v in there.items()]
        listed.append((None, None, None, json.dumps({**old, **(stats or {})})))
        self.spark.createDataFrame(listed, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/of_version={version}")
        return version

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes directories that none of the last `keep` manifests names, and returns them."""
        alive = self.versions()[-keep:]
        if not alive:
            return []
        named: dict[str, set[int]] = {}
        for v in alive:
            for table, there in self.manifest(v)[1].items():
                named.setdefault(table, set()).update(there.values())
        gone = [f"manifest/of_version={v}" for v in self.versions() if v < alive[0]]
        for table in self._names(self.root):
            if table != "manifest":
                gone += [f"{table}/{x}" for x in self._names(f"{self.root}/{table}") if int(x.removeprefix("of_version=")) <= alive[-1] and int(x.removeprefix("of_version=")) not in named.get(table, set())]
        for x in gone:
            fs, p = self._fs(f"{self.root}/{x}")
            fs.delete(p, True)
        return gone


_MANIFEST = "table string, bucket int, version long, stats string"
