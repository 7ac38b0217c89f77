"""Inverted postings in stripes of codes: (code, document, count), shuffled by stripe, summed in dense blocks, scored where they lie and reduced by document.

A code is a number below stripes * width; its stripe is code // width. A map task packs the postings of up to DOCS documents, or ENTRIES postings, into one row for each
stripe, so that a row of the shuffle holds thousands of postings and a stripe's rows are as even as the batches: a code that every document has adds one posting for each
document, as all codes do. Stripes whose postings pass SALT_ENTRIES are dealt over salts by batch; a stripe's totals are at most `width` numbers and go to each of its salts.
A task holds one dense block of `width` numbers for each side, and one row of postings.

A document's number, `row`, is batch * DOCS + its place in the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import ship

DOCS = 1 << 10
ENTRIES = 1 << 20
#: Postings of one stripe that one task scores.
SALT_ENTRIES = 1 << 22
#: Rows of totals of one stripe that one task sums.
SALT_ROWS = 1 << 12
#: What a packed row has: codes within the stripe, postings of each code, its sum; places of documents and counts, code after code.
PACKED = "stripe int, batch long, codes binary, lists binary, totals binary, docs binary, counts binary, entries long"
TOTALS = "stripe int, codes binary, totals binary"


def packed(codes: np.ndarray, docs: np.ndarray, batch: int, width: int) -> Iterator[tuple]:
    """Rows of PACKED. codes: of all occurrences in the batch, in any order; docs: the places of their documents."""
    keys, counts = np.unique(codes.astype(np.uint64) * np.uint64(DOCS) + docs.astype(np.uint64), return_counts=True)
    if not len(keys):
        return
    code, doc = (keys // np.uint64(DOCS)).astype(np.int64), (keys % np.uint64(DOCS)).astype("<u2")
    stripe = code // width
    ends = np.append(np.flatnonzero(np.diff(stripe)) + 1, len(code))
    at = 0
    for end in ends.tolist():
        s = int(stripe[at])
        heads = np.flatnonzero(np.diff(code[at:end], prepend=-1))
        yield (
            s, batch, (code[at:end][heads] - s * width).astype("<u4").tobytes(), np.diff(np.append(heads, end - at)).astype("<u4").tobytes(),
            np.add.reduceat(counts[at:end], heads).astype("<i8").tobytes(), doc[at:end].tobytes(), counts[at:end].astype("<u4").tobytes(), end - at,
        )
        at = end


def _u4(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u4")


def combined(rows: DataFrame, stripes: int, width: int, most: int = 1 << 22) -> DataFrame:
    """TOTALS of the packed rows of each task, added before anything is shuffled: a task's rows of one stripe become one row, or one for each `most` codes that it holds."""
    ship(rows.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0

        def merged() -> pa.RecordBatch:
            out = []
            for s, parts in held.items():
                codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                sums = np.zeros(len(codes), "<i8")
                np.add.at(sums, place, np.concatenate([t for _, t in parts]))
                out.append((s, codes, sums))
            return out

        def table(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in found], pa.int32()), pa.array([c.tobytes() for _, c, _ in found], pa.binary()), pa.array([t.tobytes() for _, _, t in found], pa.binary())], names=["stripe", "codes", "totals"])

        for batch in batches:
            for s, codes, totals in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.setdefault(s, []).append((_u4(codes), np.frombuffer(totals, "<i8")))
                n += len(codes) // 4
                if n >= most:
                    found = merged()
                    n = sum(len(c) for _, c, _ in found)
                    if 2 * n >= most:  # merging doesn't help any more
                        yield table(found)
                        held, n = {}, 0
                    else:
                        held = {s: [(c, t)] for s, c, t in found}
        if held:
            yield table(merged())

    return rows.select("stripe", "codes", "totals").mapInArrow(add, TOTALS)


def totals(rows: DataFrame, stripes: int, width: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """TOTALS with one row for each stripe that has postings: the sum of each code over all rows, added up in a dense block. keep stores an intermediate table."""
    some = keep(combined(rows, stripes, width))
    most = some.groupBy("stripe").count().agg(F.max("count")).first()[0] or 0
    for salts in dict.fromkeys((1 + most // SALT_ROWS, 1)):
        some = _block_sums(some, stripes, width, salts)
    return some


def _block_sums(some: DataFrame, stripes: int, width: int, salts: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stripe = np.zeros(width, np.int64), None
        for batch in batches:
            for s, codes, sums in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                stripe = s  # a partition has one stripe
                np.add.at(block, _u4(codes), np.frombuffer(sums, "<i8"))
        if stripe is not None:
            codes = np.flatnonzero(block)
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([codes.astype("<u4").tobytes()], pa.binary()), pa.array([block[codes].astype("<i8").tobytes()], pa.binary())], names=["stripe", "codes", "totals"])

    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    return some.repartitionById(stripes * salts, F.col("stripe") * salts + salt).mapInArrow(add, TOTALS)


def contributions(rows: DataFrame, sides: list[DataFrame], stripes: int, width: int, prepare: Callable[[list[np.ndarray]], object], score: Callable[[object, np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """row and a sum by name, of each document that has postings. sides: TOTALS, which meet the postings of their stripe; prepare makes of their dense blocks what
    score needs; score gives, for codes within the stripe, a whole number by name that one use adds to its document."""
    ship(rows.sparkSession)
    most = rows.groupBy("stripe").agg(F.sum("entries").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = 1 + most // SALT_ENTRIES
    none = [F.lit(None).cast("binary").alias(c) for c in ("lists", "docs", "counts")]
    n_sides = len(sides)
    met = rows.select("stripe", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int").alias("salt"), F.lit(n_sides).alias("side"), "batch", "codes", F.lit(None).cast("binary").alias("totals"), "lists", "docs", "counts")
    for k, x in enumerate(sides):
        met = met.unionByName(x.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(k).alias("side"), F.lit(None).cast("long").alias("batch"), "codes", "totals", *none))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ready = [np.zeros(width, np.int64) for _ in range(n_sides)], None
        for part in batches:
            found: list[tuple] = []
            for side, batch, codes, sums, lists, docs, counts in zip(*(part.column(k).to_pylist() for k in range(7)), strict=True):
                if side < n_sides:
                    blocks[side][_u4(codes)] = np.frombuffer(sums, "<i8")
                    continue
                if ready is None:
                    ready = prepare(blocks)
                lists, docs, counts = _u4(lists), np.frombuffer(docs, "<u2"), _u4(counts).astype(np.int64)
                sums = []
                for each in score(ready, _u4(codes)):
                    here = np.zeros(DOCS, np.int64)
                    np.add.at(here, docs, np.repeat(each.astype(np.int64), lists) * counts)
                    sums.append(here)
                has = np.unique(docs)
                found.append((batch, has.tobytes(), *(x[has].astype("<i8").tobytes() for x in sums)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary() if k else pa.int64()) for k in range(len(names) + 2)], names=["batch", "docs", *names])

    dealt = met.repartitionById(stripes * salts, F.col("stripe") * salts + F.col("salt")).sortWithinPartitions("side")
    partial = dealt.select("side", "batch", "codes", "totals", "lists", "docs", "counts").mapInArrow(add, ", ".join(["batch long, docs binary", *(f"{x} binary" for x in names)]))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for batch, pieces in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                sums, has = np.zeros((len(names), DOCS), np.int64), np.zeros(DOCS, bool)
                for p in pieces:
                    docs = np.frombuffer(p["docs"], "<u2")
                    has[docs] = True
                    for k, x in enumerate(names):
                        sums[k, docs] += np.frombuffer(p[x], "<i8")
                at = np.flatnonzero(has)
                yield pa.RecordBatch.from_arrays([pa.array(at + batch * DOCS, pa.int64()), *(pa.array(sums[k, at]) for k in range(len(names)))], names=["row", *names])

    whole = partial.groupBy("batch").agg(F.collect_list(F.struct("docs", *names)).alias("pieces"))  # one for each stripe at most
    return whole.mapInArrow(reduce, ", ".join(["row long", *(f"{x} long" for x in names)]))
