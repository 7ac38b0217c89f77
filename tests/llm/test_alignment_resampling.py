"""Cross-tokenizer alignment and target resampling against brute force, on awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from brackwater.llm import alignment, postings, registry, resampling

BASE = "The quick brown fox jumps over the lazy dog near the river bank while seven small birds sing loudly in old trees, today and tomorrow and"
TEXTS = [
    None, "", " ", "\n", "one", BASE, BASE, BASE + "\n" + BASE, "  two  blanks \n  and\n\n a\tfeed  ", "x▁y is lost", "</s> <s> <|endoftext|> <0x41>", "É Straße naïve\x0bx\x0cy z  w \x1c q\x85 r", "日本語 のテキスト 🙂 é ́x", "x" * 3000,
    " ".join(f"w{i}" for i in range(4000)), "a\r\nb \r\n c", "﻿ bom ​ zero ᠎ old", "\x00 nul", "don't we'll 'tis  'twas", "\n\nlines\n \n  more \n",
]
SCHEMA = "doc_id long, text string, row string, stripe int, codes string, score string"
ROWS = [(i if i != 4 else None, t, "r", 1, "c", "s") for i, t in enumerate(TEXTS)] + [(5, BASE, "r", 1, "c", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def whole_tokens(texts):
    """Of each text, tokens as (id, end) of both sides by whole-text encoding; empty where they don't spell the text."""
    both = alignment.sides(*alignment.default_tokenizers())
    out = []
    for t in texts:
        spelled = (" " + (t or "")).encode()
        a = both.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = both.b.encode(t, num_threads=1) if t else []
        if not t or b"".join(both.bytes_a[i] for i in a) != spelled or b"".join(both.bytes_b[i] for i in b) != spelled:
            out.append(([], []))
        else:
            out.append(([*zip(a, np.cumsum([len(both.bytes_a[i]) for i in a]).tolist(), strict=True)], [*zip(b, np.cumsum([len(both.bytes_b[i]) for i in b]).tolist(), strict=True)]))
    return out


def brute_alignment(rows):
    tokens = whole_tokens([t for _, t in rows])
    links = []
    for a, b in tokens:
        ends = {e: y for y, e in b}
        links.append([(x, ends[e]) for x, e in a if e in ends])
    count = Counter(p for one in links for p in one)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (key, _), (a, b), one in zip(rows, tokens, links, strict=True):
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups = []
        a, b, all_a, all_b = [*a], [*b], a, b
        for cut in cuts:
            sides = []
            for left in (a, b):
                n = next(k for k, (_, e) in enumerate(left) if e == cut) + 1
                sides.append(",".join(str(x) for x, _ in left[:n]))
                del left[:n]
            groups.append("|".join(sides))
        a, b = all_a, all_b
        text = ";".join(groups)
        out.append((key, len(a), len(b), len(groups), len(one), sum(count[p] == best[p[1]] for p in one), sum(count[p] for p in one), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str), {(y, x, n) for (x, y), n in count.items() if n == best[y]}


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_units_are_tokenized_as_whole_texts_are():
    both = alignment.sides(*alignment.default_tokenizers())
    assert both.cuts
    for t in filter(None, TEXTS):
        assert "".join(both.units(t)) == " " + t
    rng = np.random.default_rng(5)
    letters = [" ", " ", "\n", "\t", "a", "the", "B", "1", ".", "'s", "é", " ", "　", "\x1c", "\x85", "​", "﻿", "᠎", "語", "🙂", "\r"]
    texts = ["".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(3000)]
    for units, (a, b) in zip(both.found(texts), whole_tokens(texts), strict=True):
        want = [x for x, _ in a], [x for x, _ in b]
        got = ([], []) if units is None else ([int(x) for u in units for g in u[3].split(";") for x in g.split("|")[0].split(",")], [int(x) for u in units for g in u[3].split(";") for x in g.split("|")[1].split(",")])
        assert got == want


def test_alignment_matches_brute_force(spark, docs, monkeypatch):
    want, best = brute_alignment([(r[0], r[1]) for r in ROWS])
    got = alignment.align(docs, digest=True)
    assert sorted((tuple(r[c] for c in ALIGNED) for r in got.collect()), key=str) == want
    assert {(r["b"], r["a"], r["n"]) for r in alignment.best_pairs(docs).collect()} == best
    texts = {r["groups"] for r in alignment.align(docs.where("doc_id = 5")).collect()}
    assert {hashlib.sha256(t.encode()).hexdigest() for t in texts} == {r[7] for r in want if r[0] == 5}
    assert alignment.align(docs.limit(0)).count() == 0
    # Small batches, many salts and early flushes change nothing. (Workers get these values with the functions that use them.)
    monkeypatch.setattr(postings, "SALT_ENTRIES", 300)
    monkeypatch.setattr(postings, "SALT_ROWS", 1)
    assert sorted((tuple(r[c] for c in ALIGNED) for r in alignment.align(docs, digest=True).collect()), key=str) == want


def test_op11_returns_its_contract(spark):
    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    df = registry.queries()["op11_alignment"](spark, sf)
    assert [(n, k) for n, k in df.dtypes] == [*((c, "bigint") for c in ALIGNED[:-1]), ("groups_sha256", "string")]
    assert sorted(map(tuple, df.collect()), key=str) == brute_alignment([(r["doc_id"], r["text"]) for r in rows])[0]


def brute_resampling(rows, target, most_words=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most_words + 1) for i in range(len(w) - k + 1)]

    raw, wanted = [features(t) for _, t in rows], [features(t)[1] for t in target]
    s, t = Counter(b for _, f in raw for b in f), Counter(b for f in wanted for b in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for (key, _), (n, f) in zip(rows, raw, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_matches_brute_force(spark, docs, monkeypatch):
    target = spark.createDataFrame([(BASE,), (None,), ("seven birds",)], "text string")
    for most_words, percent in ((1, 100), (3, 50)):
        want = brute_resampling([(r[0], r[1]) for r in ROWS], [BASE, None, "seven birds"], most_words, percent=percent)
        got = resampling.resample(docs, target, most_words=most_words, percent=percent)
        assert sorted(map(tuple, got.collect()), key=str) == want
    monkeypatch.setattr(postings, "SALT_ENTRIES", 300)
    monkeypatch.setattr(postings, "SALT_ROWS", 1)
    assert sorted(map(tuple, resampling.resample(docs, target, most_words=3, percent=50).collect()), key=str) == want
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert sorted(map(tuple, resampling.resample(docs, target.limit(0)).collect()), key=str) == brute_resampling([(r[0], r[1]) for r in ROWS], [])


def test_ranks_run_on_over_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(k), 30, int(s)) for i, (k, s) in enumerate(zip(rng.integers(0, 2000, 5000), rng.integers(-50, 50, 5000), strict=True))] + [(9000 + i, 7, 30, 20) for i in range(3000)]  # one id and score holds a third
    scored = spark.createDataFrame(rows, "row long, doc_id long, n_words long, score long").repartition(5)
    got = resampling.drawn(scored, percent=60).collect()
    want = sorted(rows, key=lambda r: (-r[3], r[1], r[0]))[:4800]
    assert sorted((r["rank"], r["row"]) for r in got if r["rank"]) == [(k + 1, r[0]) for k, r in enumerate(want)] and len(got) == 8000


def test_op12_matches_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, target = (pq.read_table(f"{sf}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    df = registry.queries()["op12_resampling"](spark, sf)
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(((r[0], r[2], r[3], r[4], r[5]) for r in brute_resampling([(d["doc_id"], d["text"]) for d in docs], [b["text"] for b in target])), key=str)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert got == sorted(con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.SQL['op12_resampling']})").fetchall(), key=str)


def test_units_are_read_as_one_text_and_told_apart(monkeypatch):
    """Units of a batch go through both tokenizers as one text; one that its tokens don't spell sends only the few around it through them one by one."""
    plain = [*(f" word{i}." for i in range(300)), "\nLine", " é́x,", " 日本語🙂", " </s>", " <0x41>", "\n\n \tDon't'll", " naïve\x0bx\x0cy", "　" + "x" * 90]
    plain[-1] = " " + plain[-1]
    awkward = [" x▁y", " a\n\n \n", " \t", "\n", " "]
    one, each = (alignment.Sides(*alignment.default_tokenizers()) for _ in range(2))
    single = []
    kept = one.learn_each
    monkeypatch.setattr(one, "learn_each", lambda units: (single.extend(units), kept(units)))
    one.learn(plain)
    assert not single
    each.learn_each(plain)
    assert one.known == each.known and None not in one.known.values()
    one.learn([*plain, *awkward])
    each.learn_each(awkward)
    assert one.known == each.known and one.known[" x▁y"] is None and one.lost == each.lost == {" x▁y"}
    assert set(awkward) <= set(single) and len(single) <= len(awkward) + alignment.FEW
    # What has no tokens is known as such when it comes again, also after the units that came before were left behind.
    monkeypatch.setattr(alignment, "CACHED", 2)
    texts = ["x▁y z", "word1. word2.", "x▁y", "", "word1. x▁y"]
    for _ in range(4):
        assert [x is None for x in one.found(texts)] == [True, False, True, True, True]
