"""The pipeline's near-duplicate stage against all pairs by exact similarity."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from brackwater.llm import similar, simhash

def sets_of(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def by_pairs(rows):
    sets, root = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return {find(i) for i in range(len(rows))}, set(least.values()), {find(i) for i in range(len(rows))} - set(least)


def test_stage_drops_every_copy_at_eight_tenths(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 5000)}"
    rows, k = [(None, None), (1, ""), (2, " \n"), (3, "two words"), (4, "two words"), (5, "Two  Words"), (6, "two")], 100
    for base in range(40):
        text = [word() for _ in range(int(rng.integers(60, 400)))]
        for changes in (0, 0, 1, 2, 3, 5, 8, 13):  # from the same text to one that is too far
            copy = list(text)
            for at in rng.choice(len(copy), changes, replace=False):
                copy[at] = word()
            rows.append((k, " ".join(copy)))
            k += 1
    chain = [word() for _ in range(300)]
    for _ in range(30):  # each is near the one before, the ends are not near each other
        chain[int(rng.integers(0, 300))] = word()
        rows.append((k, " ".join(chain)))
        k += 1
    alone = [word() for _ in range(100)]
    rows += [(None, " ".join(alone)), (None, " ".join([*alone, "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    _, named, nameless = by_pairs(rows)
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    assert sorted(x for x in got if x is not None) == sorted(named)
    assert got.count(None) == len(nameless) == 1
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_fingerprints_link_what_no_band_brings_together(spark):
    """Sets whose SimHash fingerprints differ in two bits or fewer are measured, and linked only if they are similar."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 2000)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(base[:-1]), " ".join(f"x{x}" for x in rng.integers(0, 10**6, 50))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    each = similar.prints(df).withColumn("bands", F.array(F.col("doc_id"))).localCheckpoint()  # each in a band of its own
    fps = {r["doc_id"]: (r["fp"], r["sim"]) for r in each.collect()}
    assert all((fps[0][1] ^ fps[k][1]).bit_count() <= 2 for k in (1, 2))
    assert all(r["sim"] == simhash.majority(len(r["found"]), [np.array(r["found"], "<i8").view("<u8")]) for r in each.collect())
    root = {r["fp"]: r["root"] for r in similar.similar_roots(each).collect()}
    assert root[fps[0][0]] == root[fps[1][0]] == root[fps[2][0]] != root[fps[3][0]]
    alike = each.withColumn("sim", F.lit(7).cast("long")).localCheckpoint()  # one fingerprint, but the last set is like no other
    root = {r["fp"]: r["root"] for r in similar.similar_roots(alike).collect()}
    assert root[fps[3][0]] == fps[3][0] and list(root.values()).count(fps[3][0]) == 1


def test_few_links_are_merged_as_many_are(spark, monkeypatch):
    rng = np.random.default_rng(6)
    links = spark.createDataFrame([tuple(map(int, x)) for x in rng.integers(-300, 300, (250, 2))], "a long, b long")
    got = []
    for most in (simhash.SMALL, 0):
        monkeypatch.setattr(simhash, "SMALL", most)
        got.append(sorted(map(tuple, simhash.components(links, "a", "b").collect())))
    assert got[0] == got[1] and got[0]
