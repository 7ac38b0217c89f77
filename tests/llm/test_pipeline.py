"""run() against the stages done by hand: the model's scores in plain Python, DuckDB, all pairs, and the tokenizer."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from brackwater.llm import mixing, packing, quality, toxicity

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def by_sql(rows, ctes, name, path):
    pq.write_table(pa.Table.from_pylist(rows), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW t AS SELECT * FROM read_parquet('{path}')")
    kept = {r[0] for r in con.execute(f"WITH {ctes} SELECT doc_id FROM {name} WHERE kept").fetchall()}
    return [r for r in rows if r["doc_id"] in kept]


def by_pairs(rows):
    """One of each group of texts whose sets of five-word shingles are similar at 0.8 or more, which is what the stage is to keep."""
    words = [(r["text"] or "").encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r["doc_id"], least.get(find(i), r["doc_id"]))
    return [r for i, r in enumerate(rows) if r["doc_id"] == least[find(i)]]


def test_run_takes_awkward_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, columns of clashing names; then no rows at all."""
    long_ = " ".join(f"w{i % 40_000}x{i}" for i in range(60_000))
    texts = [None, "", " \n", "one", long_, long_ + " end", *[" ".join(f"{a}{i}" for i in range(30)) for a in "abcde"]]
    rows = [(i % 9 if i % 4 else None, t, ["en", None][i % 2], [None, "s"][i % 3 == 0], None, "r", 1.0) for i, t in enumerate([*texts, *texts])] + [(3, texts[-1], "en", "s", 1, "r", 1.0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, score double")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1), (2, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs, marks in (("full", df, labels), ("none", df.limit(0), labels.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        marks.write.parquet(str(tmp_path / name / "labels.parquet"))
        now = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(tmp_path / name))
            assert out.columns == now.columns, stage_name
        pieces = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(pieces) == (name == "full")
        assert all(0 <= r["start"] < r["start"] + r["length"] <= r["doc_tokens"] for r in pieces)


def test_run_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = pq.read_table(DATA / "documents.parquet").to_pylist()
    model = toxicity.fit(spark.read.parquet(str(DATA / "documents.parquet")), spark.read.parquet(str(DATA / "labels.parquet")))
    left = [r for r in rows if not model or model.score((r["text"] or "").encode()) < toxicity.CUT]
    left = by_sql(left, quality.sql_ctes("t"), "q_verdicts", tmp_path / "q.parquet")
    left = by_pairs(left)
    left = by_sql(left, mixing.sql_ctes("t"), "m_mixed", tmp_path / "m.parquet")
    assert 0 < len(left) < len(rows)
    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in left}
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {r["doc_id"] for r in got} == set(ids)
    seen = dict.fromkeys(ids, 0)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert seen == {k: len(v) for k, v in ids.items()}
