"""A bounded sample of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str, modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


@dataclass
class Sample:
    """texts (bytes), mark (a boolean for each) and weight (so that both classes weigh what they do among all labelled rows, with mean 1)."""

    texts: list[bytes]
    mark: np.ndarray
    weight: np.ndarray


def sample(docs: DataFrame, labels: DataFrame, column: str, away: Column, most: tuple[int, int], most_bytes: tuple[int, int], key: str = "doc_id", text: str = "text") -> Sample:
    """Of the documents labelled 0 and 1 in `column`, up to most[label] with the smallest hashes of their ids, in that order as far as most_bytes[label] of text go. Of several texts of
    one id the one with the smallest hash counts; an id labelled more than once has its largest label; null labels and ids don't count, nor rows for which `away` (of the column id) holds."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col(column).alias("mark")).where("id IS NOT NULL AND mark IS NOT NULL").where(~away).groupBy("id").agg(F.max("mark").alias("mark"))
    few = [marks.where(F.col("mark") == t).orderBy(F.xxhash64("id"), "id").limit(most[t]) for t in (1, 0)]
    chosen = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(few[0].unionByName(few[1])), "id")  # as many as the two bounds
    sizes = chosen.groupBy("id", "mark").agg(F.min_by(F.octet_length("text"), F.xxhash64("text")).alias("n"))
    order = lambda r: (zlib.crc32(f"order {r['id']}".encode()), r["id"])
    within, left = [], list(most_bytes)
    for r in sorted(sizes.collect(), key=order):  # as many rows as the two bounds
        left[r["mark"]] -= r["n"] or 0
        if left[r["mark"]] >= 0:
            within.append((r["id"],))
    if not within:
        return Sample([], np.zeros(0, bool), np.zeros(0))
    texts = chosen.groupBy("id", "mark").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(texts.join(F.broadcast(docs.sparkSession.createDataFrame(within, marks.select("id").schema)), "id").collect(), key=order)
    mark = np.array([bool(r["mark"]) for r in rows], bool)
    counts = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    weight = np.where(mark, counts.get(1, 0) / max(1, mark.sum()), counts.get(0, 0) / max(1, (~mark).sum()))
    return Sample([r["text"] or b"" for r in rows], mark, weight / weight.mean())


def best_cut(z: np.ndarray, found: np.ndarray, weight: np.ndarray) -> float:
    """Between two distinct values of z, or below them all, where the F1 of `found` above it is best."""
    values, place = np.unique(-z, return_inverse=True)
    hit, said = (np.cumsum(np.bincount(place, weights=x, minlength=len(values))) for x in (weight * found, weight))
    best = int((2 * hit / (said + (weight * found).sum())).argmax())
    low = -values[best + 1] if best + 1 < len(values) else -values[best] - 1
    return float((low - values[best]) / 2)


def area(z: np.ndarray, mark: np.ndarray) -> float:
    """Under the curve, ties by half."""
    _, place, count = np.unique(z, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    t = int(mark.sum())
    return float((rank[mark].sum() - t * (t + 1) / 2) / (t * (len(z) - t)))
