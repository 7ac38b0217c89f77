"""Toxicity and quality: cuts, few rows, held-out labels, and scores against plain versions."""

import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brackwater.llm import labelled, registry, toxicity, voting

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, score string, mark int"


def test_cuts_lie_between_distinct_values():
    z = np.array([3.0, 2.0, 2.0, 2.0, 1.0, 0.0])
    found = np.array([1, 1, 0, 0, 0, 0], bool)
    cut = labelled.best_cut(z, found, np.ones(6))
    assert cut not in z and cut == 2.5
    assert labelled.best_cut(np.zeros(5), np.array([1, 0, 0, 0, 0], bool), np.ones(5)) == -0.5  # one value: all or none
    rng = np.random.default_rng(1)
    for _ in range(200):
        z, found, w = rng.integers(0, 5, 20).astype(float), rng.random(20) < 0.4, rng.random(20) + 0.1
        found[0] = True
        f1 = lambda c: 2 * w[(z >= c) & found].sum() / (w[z >= c].sum() + w[found].sum())  # noqa: E731, B023
        assert f1(labelled.best_cut(z, found, w)) == pytest.approx(max(f1(c) for c in z))


def text_of(rng, words, n=60):
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def toxic_texts():
    rng = np.random.default_rng(7)
    plain = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(300)]
    bad = ["zzxqwvy", "kkvvwwq", "qyzzvkx"]
    docs = [(text_of(rng, plain) + (" " + text_of(rng, bad, 12) if i % 5 == 0 else "")).encode() for i in range(200)]
    return docs, np.arange(200) % 5 == 0


def test_toxicity_scores_are_bytes_saved(toxic_texts):
    docs, toxic = toxic_texts
    model = toxicity.Model([b" ".join(toxicity.words_of(d)) for d in docs], toxic, np.ones(200))
    assert (model.w[:3] >= 0).all() and model.w[:3].any()
    for text in (docs[0], docs[1], b"", b"one", b"zzxqwvy, KKVVWWQ!"):
        words = toxicity.words_of(text)
        one, both = (toxicity._compressor(x).compress for x in (model.coders.contents[0], model.coders.contents[1] + model.coders.contents[0]))
        windows = [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]
        saved = [len(one(x)) - len(both(x)) for x in windows]
        n = len(windows)
        x = [sum(saved) / (n + 3), math.log(0.005 + sum(s >= 2 for s in saved) / (n + 2)), math.log(0.005 + sum(s >= 3 for s in saved) / (n + 2))]
        z = sum(w * (v - m) / s for w, v, m, s in zip(model.w, x, model.mean, model.scale, strict=False)) + model.w[3] + model.shift
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)))
    said = np.array([model.score(d) >= toxicity.CUT for d in docs])
    assert (said == toxic).mean() > 0.95 and model.score(b"") < toxicity.CUT


def test_nothing_is_toxic_where_nothing_is_known_of_it(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(500)]
    docs = [text_of(rng, words).encode() for _ in range(60)]  # labels by chance: no run of bytes is significant
    model = toxicity.Model(docs, np.arange(60) % 10 == 0, np.ones(60))
    assert model.coders is None and {model.score(d) for d in [*docs, b"", None]} == {0.0}
    same = toxicity.Model([b"the same words in all"] * 40, np.arange(40) % 2 == 0, np.ones(40))
    assert same.score(b"the same words in all") < toxicity.CUT
    df = spark.createDataFrame([(i, d.decode(), "r", "s", 1) for i, d in enumerate(docs)], SCHEMA)
    for labels in ([], [(1, 1)], [(i, 0) for i in range(60)]):
        found = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {(r["score"], r["predicted"]) for r in found.collect()} == {(0.0, 0)}


def test_op5_rejects_few(spark):
    got = registry.queries()["op5_toxicity"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == pq.read_metadata(f"{SF}/documents.parquet").num_rows and sum(r["predicted"] for r in rows) < 0.3 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def test_op5_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = [r for r in registry.queries()["op5_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    truth = np.array([labels[r["doc_id"]] == 1 for r in rows])
    assert labelled.area(np.array([r["score"] for r in rows]), truth) > 0.7
    assert sum(r["predicted"] for r in rows if not labels[r["doc_id"]]) <= 0.05 * (~truth).sum()


TEXTS = [None, "", " \n ", "one", "two words", "x" * 5000, "A!! B!! C!! D!!", " ".join(f"w{i}" for i in range(5000)), "line a b c d e\nline a b c d e", "the same, the same, the same, the same, the same"]


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    rows = [(i, text_of(rng, words, 40) if i % 4 else " ".join(w + "###" for w in rng.choice(words, 40)), "r", "s", 1) for i in range(160)]
    rows += [(1000 + i, t, "r", "s", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "r", "s", 1), rows[3], rows[4]]
    labels = [(i, int(i % 4 > 0)) for i in range(160)] + [(3, 0), (None, 0), (7, None), (10_000, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")


def test_votes_match_plain_loops(spark, rated):
    docs, labels = rated
    model = voting.fit(docs, labels)
    assert (model.mark == 0).any() and (model.mark == 1).any()
    n, df = voting.document_frequencies(docs)
    texts = [r["text"] for r in docs.collect()]
    words = voting.Words()
    plain = np.zeros(voting.COLUMNS, int)
    for t in texts:
        for c in voting.counted((t or "").encode(), words)[0]:
            plain[c] += 1
    assert n == len(texts) and (plain == df).all()
    for r in voting.quality(docs, labels).collect():
        at, uses = voting.counted((r["row"]["text"] or "").encode(), words)
        v = [sum(w * model.projection[c, k] for c, w in zip(*model.weigh(at, uses), strict=True)) for k in range(model.projection.shape[1])]
        length = math.sqrt(sum(x * x for x in v))
        alike = [round(sum(a * b for a, b in zip(v, u, strict=True)) / length, 8) for u in model.vectors]
        last = sorted(alike, reverse=True)[model.setting[0] - 1]
        votes = [(max(s, 1e-6) ** model.setting[1] * w, y) for s, w, y in zip(alike, model.weight, model.mark, strict=True) if s >= last]
        p = min(1 - 1e-4, max(1e-4, sum(w * y for w, y in votes) / sum(w for w, _ in votes)))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-math.log(p / (1 - p)) - model.shift)), rel=1e-3, abs=1e-3)
        assert r["predicted"] == (r["score"] >= 0.3)


def test_quality_without_classes(spark, rated):
    docs, labels = rated
    for some, want in ((labels.limit(0), 1.0), (labels.where("quality = 0"), 0.0), (labels.where("quality = 1").where("doc_id % 2 = 1"), 1.0)):
        assert {r["score"] for r in voting.quality(docs, some).select("score").collect()} == {want}
    assert voting.quality(docs.limit(0), labels).count() == 0


def test_held_out_labels_change_no_score(spark, rated):
    docs, labels = rated
    flipped = labels.withColumn("quality", F.when(voting.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda x: sorted((r["row"]["doc_id"] or -1, r["score"]) for r in voting.quality(docs, x).collect())
    assert scores(labels) == scores(flipped)


def test_op13_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = registry.queries()["op13_quality"](spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == pq.read_metadata(f"{sf}/documents.parquet").num_rows
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    truth = np.array([labels[r["doc_id"]] == 1 for r in held])
    assert labelled.area(np.array([r["score"] for r in held]), truth) > 0.97
    assert np.mean([r["predicted"] == t for r, t in zip(held, truth, strict=True)]) > 0.95


def test_left_out_votes_are_taken_in_blocks(monkeypatch):
    from brackwater.llm import voting

    model, rng = voting.Model.__new__(voting.Model), np.random.default_rng(1)
    model.vectors = rng.normal(size=(50, 8))
    model.vectors /= np.sqrt((model.vectors**2).sum(axis=1))[:, None]
    model.mark, model.weight = (rng.random(50) < 0.5).astype(float), np.ones(50)
    alike = model.alike(model.vectors)
    np.fill_diagonal(alike, -np.inf)
    monkeypatch.setattr(voting, "BLOCK", 7)
    seen = []
    monkeypatch.setattr(voting.Model, "alike", lambda self, v, plain=voting.Model.alike: seen.append(len(v)) or plain(self, v))
    for got, s in zip(model.left_out(), voting.SETTINGS, strict=True):
        assert got == pytest.approx(model.vote(alike, *s))
    assert max(seen) == 7
