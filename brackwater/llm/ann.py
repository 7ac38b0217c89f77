"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Smallest Euclidean distance is greatest <q, x> - |x|^2 / 2. A product quantiser with 16 codewords for each pair of coordinates is fitted to a bounded
sample. Its loss weighs the part of a residual that is parallel to its vector above the rest, for that part is what changes great
inner products; codes and codewords take turns in minimising it. Every vector is coded, and |x|^2 / 2 is kept as it is. A query's table has its
inner products with all codewords, and a scan adds up one entry for each four-bit code. In each batch of SCAN_ROWS vectors the best of a query by
scan (one in SHORT, and LEAST_SHORT at least) and all that tie with the last of them are measured exactly, in double precision.

The query set is stated, so all queries meet all vectors, in blocks: a block of QUERY_BLOCK queries (a few MB) goes to all tasks, which read the
index where it lies, code by code, and keep the k nearest of each query; vectors are never copied or shuffled. Each query's k nearest of each task then
give its k nearest of all. Each block is written before the next one starts.

Defined cases: vectors null, zero, or with null or non-finite components take no part, nor do those whose number of components is
not the most common one (ties: the smaller); ties in distance go to the smaller vec_id; a row whose vec_id equals the query's is no
candidate; repeated rows stay candidates each; a null vec_id takes no part; no vectors give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.llm.common import read, ship, stored

K = 10
#: Rows that the quantiser is fitted to: those with the smallest hashes.
SAMPLE = 20_000
CODEWORDS = 16
#: How much more the parallel part of a residual counts.
PARALLEL = 4.0
ROUNDS = 8
SHORT, LEAST_SHORT = 64, 48
QUERY_BLOCK = 8192
#: Vectors scanned at once, and queries.
SCAN_ROWS, SCAN_QUERIES = 4096, 64
#: Parts of the index: one for each SCAN_ROWS vectors, up to so many; then parts grow.
MOST_PARTS = 512


def paired(x: np.ndarray) -> np.ndarray:
    """rows x pairs x 2, filled up with zeros."""
    x = x.astype(np.float64)
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2))).reshape(len(x), -1, 2)


class Quantiser:
    def __init__(self, sample: np.ndarray, parallel: float = PARALLEL, rounds: int = ROUNDS, seed: int = 1):
        pairs = paired(sample)
        rng = np.random.default_rng(seed)
        self.parallel, m = parallel, pairs.shape[1]
        self.words = np.stack([pairs[rng.choice(len(pairs), CODEWORDS, replace=len(pairs) < CODEWORDS), k] for k in range(m)]) + rng.normal(0, 1e-9, (m, CODEWORDS, 2))
        codes = None
        for _ in range(rounds):
            codes = self._code(pairs, codes)
            self._move(pairs, codes)

    def _unit(self, pairs: np.ndarray) -> np.ndarray:
        flat = pairs.reshape(len(pairs), -1)
        return (flat / np.maximum(np.sqrt((flat * flat).sum(axis=1, keepdims=True)), 1e-300)).reshape(pairs.shape)

    def _along(self, pairs: np.ndarray, codes: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """What each pair adds to the residual's part that is parallel to the vector."""
        return np.stack([((pairs[:, k] - self.words[k][codes[:, k]]) * unit[:, k]).sum(axis=1) for k in range(pairs.shape[1])], axis=1)

    def _code(self, pairs: np.ndarray, codes: np.ndarray | None, sweeps: int = 2) -> np.ndarray:
        apart = lambda k: ((pairs[:, k, None, :] - self.words[k]) ** 2).sum(axis=2)
        if codes is None:
            codes = np.stack([apart(k).argmin(axis=1) for k in range(pairs.shape[1])], axis=1)
        unit = self._unit(pairs)
        along = self._along(pairs, codes, unit)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for k in range(pairs.shape[1]):
                each = ((pairs[:, k, None, :] - self.words[k]) * unit[:, k, None, :]).sum(axis=2)
                rest = total - along[:, k]
                codes[:, k] = (apart(k) + (self.parallel - 1) * (rest[:, None] + each) ** 2).argmin(axis=1)
                along[:, k] = each[np.arange(len(codes)), codes[:, k]]
                total = rest + along[:, k]
        return codes

    def _move(self, pairs: np.ndarray, codes: np.ndarray) -> None:
        """Each codeword to where the loss of its vectors is least, the others held."""
        unit, extra = self._unit(pairs), self.parallel - 1
        along = self._along(pairs, codes, unit)
        for k in range(pairs.shape[1]):
            rest = along.sum(axis=1) - along[:, k]
            u, x = unit[:, k], pairs[:, k]
            outer = np.eye(2) + extra * u[:, :, None] * u[:, None, :]
            aim = x + extra * u * (rest + (x * u).sum(axis=1))[:, None]
            left, right = np.zeros((CODEWORDS, 2, 2)), np.zeros((CODEWORDS, 2))
            np.add.at(left, codes[:, k], outer)
            np.add.at(right, codes[:, k], aim)
            used = np.bincount(codes[:, k], minlength=CODEWORDS) > 0
            self.words[k][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            along[:, k] = ((x - self.words[k][codes[:, k]]) * u).sum(axis=1)

    def code(self, x: np.ndarray) -> np.ndarray:
        """Four-bit codes, one for each pair of coordinates."""
        return self._code(paired(x), None).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x pairs x 16: inner products with the codewords."""
        return np.einsum("qkd,kcd->qkc", paired(queries), self.words).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes in a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, 0::2] | codes[:, 1::2] << 4


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """queries x rows: sums of table entries. codes: packed; a byte looks up the sum of its two entries."""
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    double = (tables[:, 1::2, :, None] + tables[:, 0::2, None, :]).reshape(len(tables), -1, CODEWORDS * CODEWORDS)
    total = np.zeros((len(tables), len(codes)), np.float32)
    for k in range(codes.shape[1]):
        total += double[:, k].take(codes[:, k], axis=1)
    return total


class Nearest:
    """The k nearest so far of a block of queries."""

    def __init__(self, quantiser: Quantiser, ids: np.ndarray, vectors: np.ndarray, k: int, short: int):
        self.quantiser, self.ids, self.vectors, self.k, self.short = quantiser, ids, vectors, k, short
        self.best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray) -> None:
        half = (0.5 * (vectors * vectors).sum(axis=1)).astype(np.float32)
        n = min(len(ids), max(LEAST_SHORT, -(-len(ids) // self.short)))
        for at in range(0, len(self.ids), SCAN_QUERIES):
            scores = scan(self.quantiser.tables(self.vectors[at : at + SCAN_QUERIES]), codes) - half
            last = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
            for i, row in enumerate(scores, at):
                near = np.flatnonzero(row >= last[i - at])
                near = near[ids[near] != self.ids[i]]
                apart = np.sqrt(np.cumsum((vectors[near] - self.vectors[i]) ** 2, axis=1)[:, -1])  # added up from the left, as SQL does
                apart, found = np.concatenate([self.best[i][0], apart]), np.concatenate([self.best[i][1], ids[near]])
                order = np.lexsort((found, apart))[: self.k]
                self.best[i] = apart[order], found[order]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (array of doubles) of the vectors that take part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    sound = F.size("v") == F.size(F.filter("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(sound & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, short: int = SHORT, sample: int = SAMPLE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (the Euclidean distance) of each query's k nearest among vectors."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score double"
    rows = usable(vectors, key, vector)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = lengths["d"], lengths["n"]
    rows = rows.where(F.size("v") == d)
    fitted = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()])
    quantiser = spark.sparkContext.broadcast(Quantiser(fitted))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, d)
                codes = packed(quantiser.value.code(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "codes"])

    parts = min(MOST_PARTS, math.ceil(n / SCAN_ROWS))
    ship(vectors.sparkSession)
    index = stored(rows.repartition(parts, "vec_id").mapInArrow(encode, "vec_id long, v array<double>, codes binary"), "index")
    asked = stored(usable(queries, key, vector).where(F.size("v") == d), "queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    found = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)) == block).collect()  # query_block rows, about
        mine = sorted((r["vec_id"], r["v"]) for r in mine)
        held = spark.sparkContext.broadcast((np.array([x for x, _ in mine], np.int64), np.array([v for _, v in mine], np.float64).reshape(-1, d)))

        def nearest(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            state, here, waiting = Nearest(quantiser.value, *held.value, k, short), [], 0
            for batch in batches:
                if batch.num_rows:
                    here.append(batch)
                    waiting += batch.num_rows
                while waiting >= SCAN_ROWS:
                    table = pa.Table.from_batches(here).combine_chunks()
                    meet(state, table.slice(0, SCAN_ROWS))
                    here, waiting = table.slice(SCAN_ROWS).to_batches(), waiting - SCAN_ROWS
            if waiting:
                meet(state, pa.Table.from_batches(here))
            near = [(q, v, s) for q, (ss, vs) in zip(state.ids.tolist(), state.best, strict=True) for s, v in zip(ss.tolist(), vs.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in near], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        def meet(state: Nearest, table: pa.Table) -> None:
            x = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
            state.meet(table["vec_id"].to_numpy(), x, np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(x), -1))

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        best = index.mapInArrow(nearest, out).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.append(stored(best, "nearest"))
        held.unpersist()
    return reduce(DataFrame.unionByName, found)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = {
    "op2_ann": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
}
