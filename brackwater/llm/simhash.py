"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint has 64 bits, in two segments of 32. A table holds each segment's value of each *distinct* fingerprint. Two
fingerprints that differ in two bits or fewer differ in one bit or none in at least one segment, so the Hamming ball of radius 1 around
each segment value (33 values) is enumerated, its matches are fetched from the table, and all 64 bits are compared.

A segment value that more than CROWD fingerprints share would yield all pairs of a crowd. What could meet there is linked through whole
values instead: the ball of radius 1 around the whole fingerprint is enumerated (each segment's changes, the other segment held), and two
fingerprints differ in two bits or fewer exactly if these balls share a value. A value's group holds 65 fingerprints at most, so a crowd of
thousands of near copies never emits its pairs, and no link is lost.

Defined cases: null and wordless texts have fingerprint zero, and are linked like any other; a text of fewer words than a
shingle is one shingle; rows of one id each get a row; a null id never names a group unless all its ids are null (then
component_id is null); an empty table gives no rows; other columns are not read. one_of_each() decides by row: of each group it keeps
the row with the smallest id (rows without id come last; then by a hash of the text, then of all columns), so that rows of one id whose texts lie in
different groups are judged apart, and it keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.llm.common import lookup_join, read, ship, stored

SHINGLE = 3
SEED = 42
#: Hashes whose bits are counted at once.
BLOCK = 1 << 16
#: Fingerprints that may share a segment's value before they count as a crowd.
CROWD = 64
#: Links, counted first, up to which components are found in one task instead of in jobs for each round.
SMALL = 200_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the hashes of the shingles, as a signed 64-bit number."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    return majority(n, (np.array([digest(b" ".join(words[i : i + shingle]), seed) for i in range(at, min(n, at + BLOCK))], "<u8") for at in range(0, n, BLOCK)))


def majority(n: int, blocks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of n hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for hashes in blocks:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, hash (of the text), fp (long): one row for each row of docs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle, seed) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "hash", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).cast("binary").alias("text")).mapInArrow(add, "doc_id long, hash long, fp long")


def near_links(distinct: DataFrame) -> DataFrame:
    """fp_a, fp_b: links between distinct fingerprints of two differing bits or fewer: each pair, but for those of crowds, of which there are enough
    that what is connected by all pairs is connected by these. distinct: fp (long), each once."""
    segments = F.array(F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("value")), F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", 32).alias("value")))
    table = stored(distinct.select("fp", F.explode(segments).alias("e")).select("fp", "e.*"), "segments")
    busy = stored(table.groupBy("seg", "value").count().where(F.col("count") > CROWD), "busy")
    n = busy.count()
    ball = F.explode(F.expr("concat(array(value), transform(sequence(0, 31), b -> value ^ shiftleft(1L, b)))"))
    probes = table.select("fp", "seg", ball.alias("value"))
    if n:
        # Matches at a busy value are left to dense_links(): both sides of such a match have that value in their balls.
        crowded = stored(lookup_join(probes, busy, ["seg", "value"], n, how="inner").select("fp").distinct(), "crowded")
        probes, table = (lookup_join(x, busy, ["seg", "value"], n).where("count is null").drop("count") for x in (probes, table))
    met = probes.join(table.withColumnRenamed("fp", "other"), ["seg", "value"]).where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2))
    links = met.select(F.col("fp").alias("fp_a"), F.col("other").alias("fp_b")).distinct()
    return links.unionByName(dense_links(crowded)) if n else links


def dense_links(distinct: DataFrame) -> DataFrame:
    """fp_a, fp_b: enough links of two differing bits or fewer that what is connected by all pairs is connected by these, through whole values."""
    bits = F.sequence(F.lit(-1), F.lit(63))
    one = F.expr("shiftleft(1L, greatest(bit, 0))")
    probes = distinct.select("fp", F.explode(bits).alias("bit")).select(
        F.when(F.col("bit") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(one)).alias("value"), F.when(F.col("bit") >= 0, one).otherwise(F.lit(0)).alias("mask"), (F.col("bit") < 0).cast("int").alias("own")
    )
    # Each member of a value's group is the value itself, or the value with one bit changed: a mask and a flag say who is there.
    table = probes.groupBy("value").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")).where(F.bit_count("mask") + F.col("own") >= 2)
    members = table.select(
        "value",
        F.expr("concat(if(own = 1, array(value), array()), transform(filter(sequence(0, 63), b -> (mask & shiftleft(1L, b)) != 0), b -> value ^ shiftleft(1L, b)))").alias("fps"),
    ).select(F.array_min("fps").alias("fp_a"), F.explode("fps").alias("fp_b"))
    return members.where((F.col("fp_a") != F.col("fp_b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= 2)).distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, root (long): the smallest node connected with each node that has a link. Large-star and small-star steps in turn, each a
    partial minimum and a join on the node, until only stars are left or a round changes nothing; each round is written and read back.
    Up to SMALL links are merged in one task."""
    edges = stored(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v").distinct(), "edges")
    if edges.count() <= SMALL:
        return edges.repartition(1).mapInArrow(merged, "node long, root long")
    state = None
    for _ in range(most_rounds):
        # Large star: each node's larger neighbours are linked with its smallest neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: each node's smaller neighbours, and itself, are linked with the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(least, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = stored(small, "edges")
        # Stars whose centres are nobody's neighbour, and whose members have one centre each, are the components.
        if not edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() and not edges.groupBy("u").count().where("count > 1").limit(1).count():
            break
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """components() of the links u, v of one task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def roots(each: DataFrame) -> DataFrame:
    """fp, root (a fingerprint, one for each group) of each distinct fingerprint."""
    distinct = stored(each.select("fp").distinct(), "distinct")
    near = components(near_links(distinct), "fp_a", "fp_b").withColumnRenamed("node", "fp")
    return distinct.join(near, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id reachable by links of two differing bits or fewer."""
    fps = stored(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    found = stored(roots(fps), "roots")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(found, "fp")
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(found.join(least, "root").select("fp", "component_id"), "named")  # so that both sides of the last join are read from files, and Spark can split a fingerprint that many copies share
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", most_broadcast: int = 100_000, printed: Callable[..., DataFrame] = fingerprints, grouped: Callable[[DataFrame], DataFrame] = roots) -> DataFrame:
    """One row of docs for each group. printed gives doc_id, hash and fp of each row, grouped the root of each fp."""
    prints = stored(printed(docs, key, text), "prints")
    found = stored(grouped(prints), "roots")
    each = stored(prints.groupBy("fp", "doc_id", "hash").agg(F.count("*").alias("n")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash")
    firsts = each.groupBy("fp").agg(F.min(order).alias("first")).join(found, "fp")
    kept_one = firsts.groupBy("root").agg(F.min("first").alias("first"))
    named = stored(found.join(kept_one, "root").select("fp", "first"), "named")
    judged = each.join(named, "fp").select("doc_id", "hash", "n", (order == F.col("first")).alias("stays"))
    rows = docs.withColumn("__bw_hash", F.xxhash64(text))
    same = F.col(key).cast("long").eqNullSafe(F.col("__bw_gone_id")) & (F.col("__bw_hash") == F.col("__bw_gone_hash"))
    mark = lambda df: df.select(F.col("doc_id").alias("__bw_gone_id"), F.col("hash").alias("__bw_gone_hash"))
    gone = stored(mark(judged.where("not stays")).distinct(), "gone")
    kept = rows.join(F.broadcast(gone) if gone.count() <= most_broadcast else gone, same, "left_anti")
    again = stored(mark(judged.where("stays and n > 1")), "again")
    if again.limit(1).count():  # the row that stays is there more than once
        hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        twice = kept.join(again, same, "left_semi").select(F.col(key).alias("__bw_key"), "__bw_hash", F.struct(*docs.columns).alias("__bw_row"), F.xxhash64(*hashable).alias("__bw_order"))
        one = twice.groupBy("__bw_key", "__bw_hash").agg(F.min_by("__bw_row", "__bw_order").alias("r")).select("r.*")
        kept = kept.join(again, same, "left_anti").drop("__bw_hash").unionByName(one)
    return kept.select(*docs.columns)
