"""Near-duplicate groups by SimHash and exact similarity of shingle sets, for stages that are not bound to the SimHash contract.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is SIMILAR or more. The sets' SimHash fingerprints are grouped first, as in
simhash: segment tables, Hamming balls, full comparison. Each set of a group is measured against the group's first one, and linked if the two are similar.

Fingerprints that differ in two bits or fewer find few of the pairs near SIMILAR, whose fingerprints differ in about ten. So what is still apart meets in bands: candidates share one of BANDS bands of ROWS
MinHash minima each; of pairs at 0.8 the bands miss (1 - 0.8 ** 5) ** 24, about 7 in 100,000, and of closer pairs fewer.

A band's members are never brought together in one task, nor all their pairs made. First, in TRIES rounds, each set that is outside its band's largest group is measured against a
few members of one band (the pivot, then GROWTH, then GROWTH ** 2 of them by hash), which makes a dense crowd of near copies one group by a few measurements for each member. What is then still apart
is mostly sets that share much with a crowd, but not enough. They are settled exactly, by the sets' prefixes: two sets that are similar at 0.8 share one of their rarest fifths' shingles, in one order of all shingles.

* If such a shingle is rare (RARE sets have it at most), the pair meets at it. A rare shingle yields a few pairs, whatever the size of the crowd.
* Else neither shares a rare shingle with the other, so that they share no more than the lesser number of their other shingles. Sets with too few of those meet nobody; the others are
measured in their bands, against GROWTH times as many members by hash each round, until a round has had all, and only where that bound allows the pair to be linked.

So each candidate pair is measured, lies in one group already, or is ruled out by a bound: nothing is capped.

Defined cases: as in simhash; wordless texts have the empty set and are linked with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.llm.common import ship, stored
from brackwater.llm.simhash import BLOCK, SEED, components, majority, roots

SHINGLE = 5
#: Similarity from which texts are linked, in tenths.
SIMILAR = 8
BANDS, ROWS = 24, 5
#: Rounds that measure each set against a few members of one band; how many times as many a round has as the one before.
TRIES, GROWTH = 3, 4
#: Sets that share a rare shingle at most.
RARE = 8
#: Keys that are broadcast at most, counted first.
MOST_BROADCAST = 100_000
_RNG = np.random.default_rng(SEED)
_TURN = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64, endpoint=False)
_TIMES = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles, in ascending order; a text of fewer words than a shingle is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A signed number for each band; equal ones make two sets candidates."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), BLOCK >> 6):
        least = np.minimum(least, ((found[at : at + (BLOCK >> 6)] ^ _TURN) * _TIMES).min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, hash (of the text), fp (a number for the set), sim (its SimHash fingerprint; zero of the empty set), bands, found (the set): one row for each row of docs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(x.as_py()) for x in batch.column(2)]
                fps = [xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))
                sims = pa.array([majority(len(x), (x[i : i + BLOCK] for i in range(0, len(x), BLOCK))) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), sims, pa.array([bands(x) for x in sets], pa.list_(pa.int64())), found], names=["doc_id", "hash", "fp", "sim", "bands", "found"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(add, "doc_id long, hash long, fp long, sim long, bands array<long>, found array<long>")


def near(df: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` is in small; few of these are broadcast, so that df, which may hold sets, is not shuffled."""
    return df.join(F.broadcast(small) if small.count() <= MOST_BROADCAST else small, on, "left_semi")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs (each once) whose sets are similar."""
    pairs = stored(pairs.distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    met = near(sets, ends, "fp")
    left, right = met.select(F.col("fp").alias("a"), F.col("found").alias("found_a")), met.select(F.col("fp").alias("b"), F.col("found").alias("found_b"))
    both = F.size(F.array_intersect("found_a", "found_b"))
    sizes = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("found_a") + F.size("found_b")).alias("sizes"))
    return stored(sizes.where(10 * F.col("both") >= SIMILAR * (F.col("sizes") - F.col("both"))).select("a", "b"), "links")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (fp, root) with the groups that links bring together."""
    if not links.limit(1).count():
        return labels
    named = lambda side: labels.select(F.col("fp").alias(side), F.col("root").alias(f"root_{side}"))
    new = components(links.join(named("a"), "a").join(named("b"), "b"), "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("new"))
    return stored(labels.join(new, "root", "left").select("fp", F.coalesce("new", "root").alias("root")), "labels")


def by_fingerprints(each: DataFrame) -> DataFrame:
    """Pairs a, b: each set whose SimHash fingerprint is grouped with another's (links of two differing bits or fewer), and the first set of its group. each: prints()."""
    named = stored(each.select("fp", "sim").distinct(), "named")
    groups = stored(named.join(roots(named.select(F.col("sim").alias("fp"))).withColumnRenamed("fp", "sim"), "sim").select("fp", "root"), "groups")
    firsts = groups.groupBy("root").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("root", "a")
    return groups.join(firsts, "root").where("fp <> a").select("a", F.col("fp").alias("b"))


def in_order(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def of_like_size(a: str, b: str) -> Column:
    return 10 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def by_rare_shingles(sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of different groups that share a rare shingle among the rarest fifth of each (and one more); and fp, common: how many shingles of a set are not rare."""
    shingles_of = stored(sets.select("fp", F.explode("found").alias("shingle")), "shingles")
    rare = stored(shingles_of.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") <= RARE), "rare")
    has = stored(shingles_of.join(rare, "shingle"), "has")  # at most RARE rows of each shingle
    mine = has.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("rare"))  # of one set
    size = F.size("found")
    each = stored(sets.join(mine, "fp", "left").join(labels, "fp").select("fp", "root", size.alias("size"), F.coalesce(F.size("rare"), F.lit(0)).alias("n_rare"), F.slice("rare", 1, F.floor((10 - SIMILAR) * size / 10).cast("int") + 1).alias("rare")), "prefixes")
    at = each.select("fp", "root", "size", F.explode(F.filter("rare", lambda x: x["n"] > 1)).alias("x")).select("fp", "root", "size", "x.shingle")
    other = at.withColumnsRenamed({"fp": "other", "root": "other_root", "size": "other_size"})
    met = at.join(other, "shingle").where("fp < other AND root <> other_root").where(of_like_size("size", "other_size"))
    return met.select(*in_order("fp", "other")), each.select("fp", (F.col("size") - F.col("n_rare")).alias("common"))


def similar_roots(each: DataFrame) -> DataFrame:
    """fp, root (one for each group) of each distinct set of prints(), which is stored."""
    distinct = each.select("fp").distinct()
    placed = stored(each.select("fp", F.size("found").alias("size"), F.explode("bands").alias("band")).distinct(), "placed")
    shared = stored(placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared")
    members = stored(near(placed, shared, "band"), "members").withColumn("common", F.col("size"))
    grouped = stored(by_fingerprints(each), "grouped")
    alone = members.select("fp").union(grouped.select("a")).union(grouped.select("b")).distinct()
    labels = stored(alone.select("fp", F.col("fp").alias("root")), "labels")
    sets = stored(near(each.select("fp", "found"), labels.select("fp"), "fp").groupBy("fp").agg(F.first("found").alias("found")), "sets")  # equal ones of each fp
    labels = joined(labels, measured(grouped, sets))
    turn, settled = 0, False
    while True:
        here = members.join(labels, "fp")
        groups = here.groupBy("band", "root").agg(F.count("*").alias("n"), F.min(F.struct("fp", "size")).alias("first"))  # fps are hashes, so the smallest is any of them, and the same one in all bands that it shares with a crowd
        widest = groups.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("groups"), F.min("first").alias("first"), F.sum("n").alias("total")).where("groups > 1")
        widest = stored(widest.select("band", "total", F.col("most.root").alias("largest"), F.col("first.fp").alias("pivot"), F.col("first.size").alias("pivot_size")), "open")
        most = widest.agg(F.max("total")).first()[0]
        if most is None:
            break
        members = stored(here.join(widest.select("band", "largest", "total"), "band").select("band", "fp", "size", "common", "root", "largest", "total"), "members")
        if turn == TRIES and not settled:
            settled = True
            pairs, common = by_rare_shingles(near(sets, members.select("fp").distinct(), "fp"), labels)
            labels = joined(labels, measured(pairs, sets))
            members = members.select("band", "fp", "size").join(common, "fp").where(10 * F.col("common") >= SIMILAR * F.col("size"))
            continue
        outside = members.where("root <> largest")
        if turn < TRIES:  # in one band, where most are
            outside = outside.groupBy("fp", "size", "common", "root").agg(F.max(F.struct("total", "band")).alias("best")).select("fp", "size", "common", "root", "best.*")
        if turn == 0:
            met = outside.join(widest.select("band", "pivot", "pivot_size"), "band").where("fp <> pivot").where(of_like_size("size", "pivot_size")).select(*in_order("fp", "pivot"))
        else:
            few = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("fp", F.lit(turn)), F.ceil(F.col("total") / GROWTH**turn)))  # noqa: E731, B023
            every = few(members)
            if turn >= TRIES:  # a pair is measured in the first band that it shares, and from one side
                bands_of = stored(members.groupBy("fp").agg(F.sort_array(F.collect_set("band")).alias("bands")), "bands")  # BANDS of each at most
                every, outside = every.join(bands_of, "fp"), outside.join(bands_of, "fp")
            names = [c for c in ("fp", "size", "common", "root", "bands") if c in every.columns]
            other = every.select("band", "bucket", *[F.col(c).alias("other" if c == "fp" else f"other_{c}") for c in names])
            met = few(outside).join(other, ["band", "bucket"]).where("root <> other_root").where(of_like_size("size", "other_size"))
            if turn >= TRIES:
                met = met.where((F.array_min(F.array_intersect("bands", "other_bands")) == F.col("band")) & ((F.col("other_root") == F.col("largest")) | (F.col("fp") < F.col("other"))))
            # Similar at s, two sets share s / (1 + s) of their sizes' sum at least.
            met = met.where((10 + SIMILAR) * F.least("common", "other_common") >= SIMILAR * (F.col("size") + F.col("other_size"))).select(*in_order("fp", "other"))
        labels = joined(labels, measured(met, sets))
        members = members.select("band", "fp", "size", "common")
        turn += 1
        if settled and GROWTH ** (turn - 1) >= most:  # that round had all members of each band in one bucket
            break
    return distinct.join(labels, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
