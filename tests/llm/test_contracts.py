"""The ten operators against brute force and SQL, on small tables with every awkward case."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brackwater.llm import ann, chat, common, html, lm, mixing, packing, quality, registry, sharding, simhash, toxicity

DATA = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "The quick brown fox jumps over the lazy dog near the river bank while seven small birds sing loudly in old trees"
TEXTS = [
    None, "", "  \n\t ", "one", "two words", BASE, BASE, BASE, BASE.replace("seven", "eight"), "spam ham " * 60, "É Straße naïve\x0bx\x0cy\u00a0z " + BASE,
    "### $$$ %%% &&& " * 20, "line a b c d e f g h i j\nline a b c d e f g h i j\nother", "x" * 5000, " ".join(f"w{i}" for i in range(6000)), "<|endoftext|> don't 12,5% " + BASE,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, bucket int, row string"
ROWS = [(i * 3 % 17 if i else None, t, ["en", None, "de"][i % 3], ["s0", None][i % 2], len(t) if t else None, "w", i, "r") for i, t in enumerate(TEXTS)] + [(6, BASE, "en", "s0", 3, "w", 1, "r")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_statistics(docs, empty):
    got = sorted(((r["row"]["text"] or "", r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality_verdicts(docs).collect()), key=str)
    want = []
    for _, t, *_ in ROWS:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want.append((t, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    assert got == sorted(want, key=str)
    assert quality.quality_verdicts(empty).count() == 0


def test_quality_fences_follow_their_group(spark):
    odd = "a# b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd"  # one symbol for 34 letters, about 29 per thousand
    rows = [(i, " ".join(f"{x}{i}" for x in odd.replace("#", "").split()), "en", "plain") for i in range(300)] + [(1000 + i, "### " * 5 + " ".join(f"{x}{i}" for x in odd.split()), "en", "marked") for i in range(300)]
    rows += [(1, "### " * 5 + odd, "en", "plain")]
    got = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("row.doc_id", "source", "kept").collect()
    assert all(r["kept"] for r in got if r["source"] == "marked")
    assert sum(not r["kept"] for r in got if r["source"] == "plain") == 1


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_quality_fences_differ_between_groups(spark):
    stats = quality.quality_stats(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), keep=["doc_id"])
    found = quality.fences(common.stored(quality.sketches(stats), "sketches")).collect()
    for k in ("dup_line_rate", "repeat_rate", "word_length"):  # of symbols, ordinary groups have none
        assert len({r[f"high_{k}"] for r in found}) > 3, k
    marked = spark.createDataFrame([("en", s, k, b, n) for s, b in (("plain", 0), ("marked", 96)) for k in quality.RULES for b, n in ((b, 270), (b * 2, 30))], "lang string, source string, rate string, bucket long, n long")
    assert {r["source"]: r["high_symbol_rate"] for r in quality.fences(marked).collect()} == {"plain": 0, "marked": 96}


def test_sketches_merge(docs):
    stats = quality.quality_stats(docs)
    whole = quality.sketches(stats)
    parts = quality.sketches(stats.where("n_words < 20")).unionByName(quality.sketches(stats.where("n_words >= 20"))).groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)).astype("float32")
    x[300:] = x[0]  # one vector, a hundred times
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)] + [(5000, None, ""), (5001, [0.0] * 5, ""), (5002, [float("nan")] * 5, ""), (5003, [1.0, None, 1.0, 1.0, 1.0], ""), (5004, [1.0], ""), (None, [1.0] * 5, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    asked = df.where("vec_id % 100 = 0")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(df, asked).collect()}
    y = x.astype(float)
    for q in (0, 100, 200, 300):
        d = np.sqrt(np.cumsum((y - y[q]) ** 2, axis=1)[:, -1])
        order = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, d[i]) for i in order]
    assert len(got) == 40
    assert ann.search(df.limit(0), asked).count() == 0
    assert ann.search(df.where("vec_id < 3"), asked).where("query_id = 0").count() == 2


def test_recall_where_the_quantiser_decides(spark):
    rng = np.random.default_rng(11)
    n, d = 32_768, 64
    x = (rng.normal(size=(n, d)) * rng.lognormal(0, 0.5, size=(n, 1))).astype("float32")  # of varied length
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 400 = 0"), query_block=50).collect()
    y, hits, asked = x.astype(float), 0, range(0, n, 400)
    found = {q: {r["vec_id"] for r in got if r["query_id"] == q} for q in asked}
    for q in asked:
        apart = ((y - y[q]) ** 2).sum(axis=1)
        apart[q] = np.inf
        hits += len(found[q] & set(np.argsort(apart, kind="stable")[:10].tolist()))
    assert ann.SCAN_ROWS // ann.SHORT <= 0.02 * ann.SCAN_ROWS and hits / (10 * len(asked)) >= 0.9


def test_quantiser_prefers_small_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    along = []
    for weight in (1.0, ann.PARALLEL):
        q = ann.Quantiser(x, parallel=weight)
        p = ann.paired(x)
        codes = q.code(x)
        made = np.stack([q.words[k][codes[:, k]] for k in range(p.shape[1])], axis=1)
        flat = p.reshape(len(x), -1)
        along.append(np.mean((((p - made).reshape(len(x), -1) * flat).sum(axis=1) / np.linalg.norm(flat, axis=1)) ** 2))
    assert along[1] < along[0]
    t, c = q.tables(x[:4]), codes[:50]
    assert np.allclose(ann.scan(t, ann.packed(c)), [[sum(t[i, k, c[j, k]] for k in range(t.shape[1])) for j in range(50)] for i in range(4)], atol=1e-5)


def test_html_extraction(spark):
    page = lambda body: f"<html><head><title>t</title><script>if(a<b)'</p>'</script></head><body><nav>menu</nav><div class='page has-sidebar'><div class='story-1'><h1>H&eacute;ad</h1>{body}</div><div class='zone'>about this site and its makers</div></div><footer>f</footer></body></html>"
    text = "word " * 120
    rows = [(i, f"http://h.example/{i}", page(f"<p>{text}<b>bo</b>ld &lt;x&gt;</p><p>b\n c<br>d</p><div class='comments'>no</div>")) for i in range(6)]
    rows += [(10, "http://h.example/10", page("<p>short</p>")), (11, None, None), (12, "", "plain <text"), (13, "http://q/", "<p>un<b>closed <p>next"), (13, "http://q/", "<p>un<b>closed <p>next"), (14, "http://z/", "<!-- never ends <p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("host", F.lit("mine"))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[0]["main_text"] == "Héad " + text + "bold <x> b c d"
    assert got[10]["main_text"] == "Héad short"  # by the host's path, though the page by itself would take in more
    assert html.Page(rows[6][2]).main_text(None) != "Héad short"
    clash = html.extract(df.withColumn("main_text", F.lit("old")).withColumn("gone", F.lit(1)))
    assert clash.columns.count("main_text") == 1 and {r["page_id"]: r["main_text"] for r in clash.collect()}[10] == "Héad short"
    assert got[11]["main_text"] == "" and got[13]["main_text"] == "unclosed next" and got[14]["main_text"] == "" and got[0]["host"] == "mine"
    assert html.extract(df).count() == len(rows) and html.extract(df.limit(0)).count() == 0


def test_html_frames_nesting_and_depth():
    body = "word " * 100
    read = lambda x: html.Page(x).main_text(None)
    assert read(f"<form id='aspnetForm'><div class='wrap'><p>{body}</p></div></form>") == body.strip()
    assert read(f"<div class='sidebar-right'><p>{body}</p><div class='comments'>x y</div></div>") == body.strip()
    assert read('<p>a <span class="share"><span>x</span> y</span> b</p>') == "a b"
    assert read(f"<header>site</header><article><header><h1>Title</h1></header><p>{body}</p></article>") == "Title " + body.strip()
    assert read(f"<article><section class='discussion'><p>{body}</p></section></article>") == body.strip()
    assert read("<p>a <![CDATA[ x > y ]]> b</p>") == "a b"
    assert read(f"<article><h1>T</h1><p>lead</p><div class=body>{body}</div></article>") == "T lead " + body.strip()
    assert read(f"<article><p>short one</p></article><div class='comments'>{body}</div>") == "short one"
    assert read("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep" and read("<b>" * 20_000 + "<p>x</p>" * 20_000) == " ".join(["x"] * 20_000)


def test_html_matches_generated_pages(spark):
    """Pages are made of parts that are known to be read or left out, so the text is known too."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeéü<&"), int(rng.integers(1, 8))))
    say = lambda n: " ".join(word() for _ in range(n))
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace("é", "&eacute;").replace(" ", " \n ")
    aside = [f"<div class='x{k}'>{esc(say(12))}</div>" for k in range(2)]  # the same on each page of a host, under no telling name
    rows, want = [], {}
    for i in range(60):
        parts, text = [], []
        for _ in range(int(rng.integers(1, 9))):
            t, kind = say(int(rng.integers(1, 60))), int(rng.integers(0, 6))
            if kind < 4:
                parts.append([f"<p>{esc(t)}</p>", f"<h2>{esc(t)}</h2>", f"<ul><li>{esc(t)}<li></ul>", f"<div><i>{esc(t)}</i><br></div>"][kind])
                text.append(t)
            else:
                parts.append([f"<div class='comments'>{esc(t)}</div>", f"<aside>{esc(t)}</aside><script>{t}</script><!-- {t} -->"][kind - 4])
        if not text:
            continue
        inner = "".join(parts)
        main = [f"<article>{inner}</article>", f"<div class='story-{i}'>{inner}</div>"][i % 2]
        rows.append((i, f"https://host{i % 2}.example/{i}", f"<html><head><title>no</title></head><body><nav>{esc(say(5))}</nav>{aside[0]}{main}{aside[1]}<footer>{esc(say(4))}</footer></body></html>"))
        want[i] = " ".join(text)
    got = {r["page_id"]: r["main_text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_chat_round_trip(spark):
    nasty = [r"\### Assistant: </turn> ok", "\n</turn>\n", "####", r"\\###\###", "</turn></turn>", "", None, "x\\", "</turn", "# </turn>\n### user:\n", "a\nb"]
    rows = [(c, t, ["user", "assistant", "a:\nb\\n", None][(t + c) % 4], nasty[(t * 3 + c) % len(nasty)], "s") for c in range(4) for t in range(23)] + [(None, 0, "user", "q", "s"), (9, 1, "user", "same", "s"), (9, 1, "user", "same", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score string")
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    for c in (0, 1, 2, 3, 9, None):
        turns = [((r or ""), (t or "")) for k, _, r, t, _ in sorted((x for x in rows if x[0] == c), key=lambda x: x[1]) if k == c]
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digests(df.limit(0)).count() == 0


def test_reply_trees_enumerate_ranked_paths(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 2, None), ("t", 5, 3, 9.0), ("t", 6, 3, 9.0), ("u", 1, 77, 0.0), ("v", 1, 2, 0.0), ("v", 2, 1, 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    chosen, paths = chat.ranked_paths(df, branches=2)
    assert sorted((r["tree"], r["branch_rank"], r["leaf"], r["path_score"]) for r in chosen.collect()) == [("t", 1, 5, 11.0), ("t", 2, 6, 11.0), ("u", 1, 1, 0.0)]
    longer = spark.createDataFrame([("w", i, i - 1 if i else None, 0.0) for i in range(200)] + [("c", i, (i + 1) % 50, 0.0) for i in range(50)], "tree string, node long, parent long, score double")
    assert chat.ranked_paths(longer)[1].groupBy("tree").count().collect() == [("w", 200)]
    assert sorted((r["leaf"], r["depth"], r["node"]) for r in paths.where("tree = 't'").collect()) == [(5, 1, 1), (5, 2, 3), (5, 3, 5), (6, 1, 1), (6, 2, 3), (6, 3, 6)]


def test_toxicity_learns_only_what_it_may(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("abdeghiklmnoprstu"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocab, 60))
        toxic = i % 4 == 0
        if toxic:
            w[5::12] = rng.choice(["zwyxqvile", "zqwyxfoul"], len(w[5::12]))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "zwyxqvile", "x"), (3, rows[3][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (9000, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab).select("row.doc_id", toxicity.held_out("row.doc_id").alias("held"), "score", "predicted").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    assert np.mean([(r["doc_id"] % 4 == 0) == bool(r["predicted"]) for r in held]) > 0.95
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(df, flipped).select("row.doc_id", "score").collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in got)
    monkeypatch.setattr(toxicity, "MOST_BYTES", (60_000, 20_000))  # less text than the labels are of; ids with several texts; a very long text
    long_ = spark.createDataFrame([(9100, "plain words " * 200_000, "x"), (3, "another text of the id three", "y")], df.schema)
    more = df.unionByName(long_)
    one, two = (sorted((str(r["doc_id"]), r["score"]) for r in toxicity.toxicity(d, lab).select("row.doc_id", "score").collect()) for d in (more, more.repartition(7)))
    assert one == two and len(one) == len(rows) + 2
    none = toxicity.toxicity(df, lab.limit(0)).collect()
    assert len(none) == len(rows) and {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity(df.limit(0), lab).count() == 0


def test_language_model_base_and_sums(docs, empty):
    held = lm.held_out("doc_id", 7, 2)
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.lm_scores(docs, held=held).collect())
    toks = [(i, [w.decode() for w in lower(t).encode().split()] + [None]) for i, t, *_ in ROWS]
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    c = Counter(w for i, t in toks if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    assert got == Counter((i, out(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in toks)
    assert all(r["score"] < 0 for r in lm.lm_scores(docs, held=held).collect())
    assert lm.lm_scores(empty).count() == 0


def test_language_model_scores_by_brute_force(docs):
    """Every document's probability, word by word in its order, from plain counts."""
    held = lm.held_out("doc_id", 7, 2)
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    toks = [(i, lower(t).encode().split(), g) for i, t, g, *_ in ROWS]
    learnt = [x for x in toks if not out(x[0])]
    langs = [g for g, _ in sorted(Counter(g for _, _, g in learnt).items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))]
    by = {g: Counter(w for _, t, h in learnt if h == g for w in t) for g in langs}
    all_ = sum(by.values(), Counter())
    size = lm._vocabulary(lm.default_vocabulary()).get_piece_size()
    lattice = lm.Lattice(lm.default_vocabulary(), np.zeros(size), np.zeros(size), 0)
    for _ in range(lm.ROUNDS):
        first, going = np.zeros(size), np.zeros(size)
        for table, uses in zip((first, going), lattice.expected_uses(list(all_)), strict=True):
            for piece, x in uses.items():
                table[lm._vocabulary(lm.default_vocabulary()).piece_to_id(piece)] = x
        lattice = lm.Lattice(lm.default_vocabulary(), first, going, len(all_))

    def discounted(counts, ends, uses, rest):
        n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
        ones, twos = (sum(x == k for x in [*counts.values(), ends]) for k in (1, 2))
        d = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))
        return rest if not n else max(uses - d, 0) / n + d * v / n * rest

    ends = Counter(g for _, _, g in learnt)
    n_all, v_all, n_ends = sum(all_.values()) + len(learnt), len(all_) + 1, len(learnt)
    want = []
    for i, t, _ in toks:
        total = []
        for g in [*langs, "others"]:
            counts, e = by.get(g, Counter()), ends.get(g, 0)
            p = {w: discounted(counts, e, counts[w], discounted(all_, n_ends, all_[w], math.exp(lattice.log_probability(w)))) for w in set(t)}
            seen, log = Counter(), math.log((e + 1) / (n_ends + len(langs) + 1)) + math.log(discounted(counts, e, e, discounted(all_, n_ends, n_ends, 1 / (n_all + v_all))))
            for k, w in enumerate(t):
                log += math.log((seen[w] + lm.FIRMNESS * p[w]) / (k + lm.FIRMNESS))
                seen[w] += 1
            total.append(log)
        top = max(total)
        want.append((str(i), len(t) + 1, (top + math.log(sum(math.exp(x - top) for x in total))) / math.log(10)))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.lm_scores(docs, held=held).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5, abs=1e-4)


def test_log_gamma():
    x = np.array([1.0, 1.5, 2.0, 37.25, 1e6])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def test_lattice_sums_all_segmentations():
    n = lm._vocabulary(lm.default_vocabulary()).get_piece_size()
    model = lm.Lattice(lm.default_vocabulary(), np.zeros(n), np.zeros(n), 0)

    def total(s, start):
        if not s:
            return 1.0
        table = model.first if start else model.going
        out = sum(math.exp(p) * total(s[k:], False) for k in range(1, len(s) + 1) if (p := table.get(s[:k])) is not None)
        if not start:
            out += math.exp(sum(model.bytes[b] for b in s[0].encode())) * total(s[1:], False)
        return out

    for word in ("the", "tionly", "é", "日x"):
        assert model.log_probability(word.encode()) == pytest.approx(math.log(total("▁" + word, True)) + model.stop)
    starts, inner = model.expected_uses([b"the", b"a" * 200])
    assert 1.99 < sum(starts.values()) + 0 < 2.01 and sum(inner.values()) > 0
    ids, times = lm.unpacked(lm.packed(np.array([5, 1, 5, 9], np.int32)))
    assert ids.tolist() == [1, 5, 9] and times.tolist() == [1, 2, 1]


def test_shuffle_is_a_gapless_permutation(docs, empty, spark):
    got = sharding.external_shuffle(docs).collect()
    assert Counter((r["doc_id"], r["text"], r["words"], r["bucket"]) for r in got) == Counter((x[0], x[1], x[5], x[6]) for x in ROWS)
    by = Counter(r["shard"] for r in got)
    assert max(by.values()) - min([by[s] for s in range(16)]) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s])) for s in by)
    again = sharding.external_shuffle(docs.repartition(5)).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in again) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in got)
    assert sharding.external_shuffle(empty).count() == 0
    hot = spark.createDataFrame([(1, "x" * 100)] * 900 + [(i, "y" * 100) for i in range(2, 900)], "doc_id long, text string").repartition(4)
    spread = sharding.external_shuffle(hot, bucket_bytes=4000).collect()  # one row fills half of the table
    assert len(spread) == 1798 and len({(r["shard"], r["slot"]) for r in spread}) == 1798


def test_shards_are_written_in_slot_order(spark, docs, tmp_path):
    out = sharding.external_shuffle(docs.unionByName(docs).unionByName(docs), shards=5, bucket_bytes=2000)
    out = common.stored(out, "shuffled")
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["shard"], r["slot"], str(r["doc_id"])) for r in back.collect()) == sorted((r["shard"], r["slot"], str(r["doc_id"])) for r in out.collect())
    for f in (tmp_path / "shards").rglob("*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(f)).select("slot").collect()]
        assert slots == sorted(slots)


def test_raking_meets_targets_and_lots_are_fixed(docs, empty, spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 300)), f"s{i % 3}", ["en", "de"][int(rng.random() < 0.2)], "t") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string")
    targets = {"source": {"s0": 2, "s1": 1, "s2": 1}, "lang": {"en": 1, "de": 1}}
    cells = mixing.raked(mixing.cells_of(mixing.mixed(df, targets=targets)), targets, budget=0.2).collect()
    share = lambda m, v: sum(c["share"] for c in cells if c[m] == v)
    assert [share("source", s) for s in ("s0", "s1", "s2")] == pytest.approx([0.5, 0.25, 0.25], abs=1e-6) and share("lang", "de") == pytest.approx(0.5, abs=1e-3)
    dealt = {(c["source"], c["lang"], c["topic"]): c["share"] for c in mixing.raked(mixing.cells_of(mixing.mixed(df, targets=targets)), targets, budget=0.2, one_task_cells=1).collect()}
    assert dealt == pytest.approx({(c["source"], c["lang"], c["topic"]): c["share"] for c in cells})  # by joins, when there are many cells
    off = mixing.residuals(spark.createDataFrame(cells)).collect()
    assert len(off) == 3 + 2 + len({c["topic"] for c in cells}) and max(abs(r["residual"]) for r in off) < 1e-3
    even = mixing.raked(mixing.cells_of(mixing.mixed(df)), {"source": 0, "lang": {"en": 3.0, mixing.OTHERS: 1.0}}).groupBy("lang").agg(F.sum("share").alias("s")).collect()
    assert {r["lang"]: r["s"] for r in even} == pytest.approx({"en": 0.75, "de": 0.25}, abs=1e-3)
    total = sum(c["tokens"] for c in cells)
    assert sum(c["tokens"] * c["probability"] for c in cells) == pytest.approx(0.2 * total, rel=1e-6)
    got = mixing.mixed(df, targets=targets, budget=0.2)
    kept = got.where("kept").groupBy("lang").agg(F.sum("tokens").alias("n")).collect()
    assert 0.4 < next(r["n"] for r in kept if r["lang"] == "de") / sum(r["n"] for r in kept) < 0.6
    assert {r["doc_id"] for r in got.where("kept").select("row.doc_id").collect()} == {r["doc_id"] for r in mixing.mixed(df.repartition(7), targets=targets, budget=0.2).where("kept").select("row.doc_id").collect()}
    assert mixing.mixed(docs).count() == len(ROWS) and mixing.mixed(empty).count() == 0
    assert mixing.mixed(df, targets={"source": {"none": 1}}).where("kept").count() == 0


def groups_by_brute_force(rows):
    fps = [simhash.fingerprint(t.encode() if t else None) & (1 << 64) - 1 for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], fps[i], least.get(find(i))) for i, r in enumerate(rows)]


def test_simhash_groups(docs, empty, spark):
    key = lambda x: str(x)
    got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=key)
    assert got == sorted(groups_by_brute_force(ROWS), key=key)
    assert simhash.near_duplicates(empty).count() == 0
    stay = simhash.one_of_each(docs).collect()
    named = sorted(r["doc_id"] for r in stay if r["doc_id"] is not None)
    assert named == sorted({c for _, _, c in got if c is not None}) and stay[0].asDict().keys() == docs.first().asDict().keys()


def test_one_of_each_decides_by_row(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(0, b, 1), (1, a, 2), (1, b, 3), (1, a, 2), (None, a, 4), (None, "alone " * 9, 5), (None, "alone " * 9, 5), (7, "alone " * 8, 6), (8, None, 7), (9, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int")
    for stay in (simhash.one_of_each(df), corpus_pipeline.drop_near_duplicates(spark, df, "")):
        got = [(r["doc_id"], r["text"]) for r in stay.collect()]
        assert stay.columns == df.columns and sorted(got, key=str) == sorted([(0, b), (1, a), (7, "alone " * 8), (8, None)], key=str)


def test_simhash_fingerprint_by_definition():
    import xxhash

    for t in TEXTS[3:]:
        w = WORD.findall(lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
        assert simhash.fingerprint(t.encode()) & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("way", "crowd"), [("near_links", 64), ("near_links", 2), ("dense_links", 64)])
def test_links_lose_nothing(spark, monkeypatch, way, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 6)]
    fps = set(base)
    for b in base:  # dense groups: a walk of one and two bits from each
        for _ in range(60):
            for bit in rng.choice(64, int(rng.integers(1, 3)), replace=False):
                b ^= 1 << int(bit) if bit < 63 else -(1 << 63)
            fps.add(b)
    links = getattr(simhash, way)(spark.createDataFrame([(x,) for x in fps], "fp long"))
    found = {r["node"]: r["root"] for r in simhash.components(links, "fp_a", "fp_b").collect()}
    rows = [(x, None) for x in sorted(fps)]
    u = [x & (1 << 64) - 1 for x, _ in rows]
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    together = lambda f: {frozenset(k for k in u if f(k) == f(x)) for x in u}
    assert together(lambda x: found.get(x - (1 << 64) if x >> 63 else x, x - (1 << 64) if x >> 63 else x)) == together(find)


def test_packing_cuts_every_document_exactly(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    assert 49407 in t.encode(TEXTS[-1], add_special_tokens=False).ids
    pieces = packing.pack(docs)
    rows = pieces.collect()
    want = Counter(tuple([*t.encode(x[1] or "", add_special_tokens=False).ids, 2]) for x in ROWS)
    whole, at = Counter(), {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["doc_tokens"], r["start"])):
        at.setdefault((r["doc_id"], r["doc_tokens"]), {}).setdefault(r["start"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(r["ids"]) == 4 * r["length"] > 0
    for _, parts in at.items():
        copies = max(map(len, parts.values()))
        whole[tuple(i for s in sorted(parts) for i in parts[s][0])] += copies
    assert sum(want.values()) == len(ROWS) and set(whole) <= set(want)
    assert sum(r["length"] for r in rows) == sum(len(k) * n for k, n in want.items())
    seqs = packing.sequences(pieces).collect()
    assert all(s["padding"] == 0 and len(s["ids"]) == 4 * s["n_tokens"] <= 4 * 4096 for s in seqs)
    assert sum(s["n_tokens"] == 4096 for s in seqs) >= len(seqs) - 12
    assert packing.pack(empty).count() == 0


def test_packing_fills_windows_to_targets(spark):
    rows = [(i, "alpha beta gamma delta " * 40, ["a", "b", None, "c", "d"][i % 5], "x") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, length string")
    total = packing.pack(df).agg(F.sum("length")).first()[0]
    for targets, queues in (({"a": 3, "b": 1}, 4096), ({"a": 3, "b": 1}, 2), ({"none": 1.0}, 4096), ({"a": 0, "b": 0.0}, 4096), ({"a": -1.0, "b": 2.0}, 3)):
        pieces = packing.pack(df, targets=targets, length=1024, quantum=64, most_queues=queues)
        held = pieces.join(df.select("doc_id", "source"), "doc_id").where("sequence_id < 12").groupBy("source").agg(F.sum("length").alias("n")).collect()
        held = {r["source"]: r["n"] for r in held}
        assert pieces.agg(F.sum("length")).first()[0] == total
        if targets == {"a": 3, "b": 1}:
            assert held["a"] / sum(held.values()) == pytest.approx(0.75, abs=0.02) and held["b"] / sum(held.values()) == pytest.approx(0.25, abs=0.02)


def test_packing_keeps_proportions_and_deficits():
    lengths = [700_000, 200_000, 100_000, 37]
    lay = packing.Layout(lengths, lengths)
    docs = [(q, s, min(900, n - s)) for q, n in enumerate(lengths) for s in range(0, n, 900)]
    q, s, n = (np.array(x) for x in zip(*docs, strict=True))
    doc, _, k, seq, offset = lay.pieces(q, s, n)
    held = np.zeros((seq.max() + 1, 4), int)
    np.add.at(held, (seq, q[doc]), k)
    full = held[: sum(lengths) // 4096]
    assert (full.sum(axis=1) == 4096).all() and np.abs(full - full.mean(axis=0))[:-8].max() <= 2 * packing.QUANTUM
    assert np.abs(np.cumsum(full[:-8, :3], axis=0) - np.arange(1, len(full) - 7)[:, None] * 4096 * np.array(lengths[:3]) / sum(lengths)).max() <= 4 * packing.QUANTUM
    for x in range(int(seq.max()) + 1):
        o = np.argsort(offset[seq == x])
        assert (np.cumsum(k[seq == x][o]) - k[seq == x][o] == offset[seq == x][o]).all()


def test_pipeline_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
    kept = {r["bucket"] for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()}
    assert 5 in kept and 9 not in kept and 11 not in kept and 0 not in kept


def test_lookup_joins_agree(spark):
    big = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (7, "d")], "k int, v string")
    small = spark.createDataFrame([(1, "x"), (None, "y")], "k int, w string")
    one, two = (sorted(map(str, common.lookup_join(big, small, ["k"], n, max_rows=10, salts=3).collect())) for n in (2, 99))
    assert one == two and len(one) == 4


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = registry.queries()[name](spark, str(DATA))
    cols, want = sorted(got.columns), con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
