"""Operators on small tables whose results are known by hand."""

import json

import pytest
from pyspark.sql import functions as F

from brackwater.functions import text as fn
from brackwater.operators import config, evaluation, graph, history, memory, overlay, resources, retrieval
from brackwater.sources import files
from brackwater.streaming import overlay as stream


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, fn.subtokens(lit("parseHTTPResponse_v2 x"))) == ["parse", "httpresponse", "v2"]
    assert one(spark, fn.norm_key(lit(' "user:${id}" '))) == "user:{}"
    assert one(spark, fn.norm_key(lit("''"))) is None
    assert [one(spark, fn.last_name(lit(x))) for x in ("repo.find(x).y", "this.userRepo", "ctx.getRepository()", "kafka.template()", "call(x)", "")] == ["y", "userRepo", "getRepository", "template", "call", ""]
    assert one(spark, fn.config_key(lit(" MY_app-Key "))) == "my.app.key"
    assert one(spark, fn.tickets(lit("fix #12 and ABC-7"))) == ["12", "ABC-7"]
    assert one(spark, fn.is_fix(lit("Hotfix: x"))) and not one(spark, fn.is_fix(lit("prefix")))
    assert one(spark, fn.name_suffixes(lit("a.B$C.lambda$run$0"))) == ["a.B.C.run", "B.C.run", "C.run", "run"]
    assert [len(p) for p in one(spark, fn.passages(lit("x" * 3000)))] == [1400, 1400, 600]
    assert one(spark, fn.passages(lit(""))) == [""]
    assert one(spark, fn.relevance(lit("src/tests/a.py"))) == 0.25 and one(spark, fn.relevance(lit("src/a.py"))) == 1.0
    assert one(spark, fn.seeds(lit("Crash in parser"), lit("call `loadFile` or util.read_all() in pkg/io.py"))) == ["Crash", "io.py", "loadFile", "parser", "pkg/io.py", "read_all"]
    assert one(spark, fn.env_label(lit(""), lit(None).cast("string"), lit("prod"))) == "prod"
    assert one(spark, fn.redacted(lit("db.password"), lit("x"))) == "***"


def test_bm25_counts_repeats_and_replaces_negative_idf(spark):
    import math

    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a"]), (3, ["c", "a"]), (4, ["d", "e"])], "id int, t array<string>")
    got = {r["id"]: r["score"] for r in retrieval.bm25(docs, "id", F.col("t"), ["a", "a", "b"]).collect()}
    raw = {"a": math.log(1.5) - math.log(3.5), **{x: math.log(3.5) - math.log(1.5) for x in "bcde"}}
    mean = sum(raw.values()) / 5
    part = lambda idf, tf: idf * tf * 2.5 / (tf + 1.5)
    assert got[1] == pytest.approx(2 * part(0.25 * mean, 1) + part(raw["b"], 1))
    assert got[2] == pytest.approx(2 * part(0.25 * mean, 2)) and 4 not in got


def test_runtime_arms_never_lower_a_score(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "id string, score double")
    near = spark.createDataFrame([("b", 1.0)], "id string, prox double")
    sure = spark.createDataFrame([("a",)], "id string")
    for mode, want in (("off", (1.0, 0.5)), ("tag", (1.0, 0.5)), ("prior", (1.5, 0.5)), ("fused", (1.5, 1.1))):
        got = dict(rows(retrieval.runtime_arm(scores, "id", near, sure, mode), "id", "score"))
        assert (got["a"], got["b"]) == pytest.approx(want)
    with pytest.raises(ValueError):
        retrieval.runtime_arm(scores, "id", near, sure, "other")


def test_commit_filters(spark):
    c = spark.createDataFrame([(1, 5, "ann", "fix x", ["a"]), (2, 6, "dependabot[bot]", "y", ["a"]), (3, 7, "bo", "bump z", ["a"]), (4, 8, "bo", "big", ["f"] * 31), (5, 9, "bo", "none", [])], "id int, ts long, author string, msg string, files array<string>")
    assert rows(history.usable_commits(c), "id") == [(1,)]


def test_page_rank_matches_a_plain_loop(spark):
    e = [(1, 2), (2, 3), (3, 1), (3, 4), (3, 4)]
    got = {r["id"]: (r["pr"], r["base"]) for r in graph.page_rank(spark.createDataFrame(e, "src int, dst int"), spark.createDataFrame([(1, 1.0)], "id int, weight double"), rounds=8).collect()}
    nodes, edges = [1, 2, 3, 4], set(e)
    deg = {n: sum(s == n for s, _ in edges) for n in nodes}
    for i, start in enumerate(({n: ((n == 1) + 1e-9) / (1 + 4e-9) for n in nodes}, dict.fromkeys(nodes, 0.25))):
        r = dict(start)
        for _ in range(8):
            hang = sum(r[n] for n in nodes if not deg[n])
            r = {n: 0.5 * (sum(r[s] / deg[s] for s, d in edges if d == n) + hang * start[n]) + 0.5 * start[n] for n in nodes}
        assert all(got[n][i] == pytest.approx(r[n]) for n in nodes)


def test_breadth_first(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert rows(graph.within(e, spark.createDataFrame([(1,)], "id int"), 2), "id", "hop") == [(1, 0), (2, 1), (3, 2)]


def test_classifier_order(spark):
    calls = [("redisTemplate", "delete", "'k'", None), ("map", "delete", "'k'", None), ("repo", "delete", "x", None), ("box", "send", None, None), ("self", "save", "x", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(calls)], "fn_id int, receiver string, method string, arg0 string, type string")
    assert rows(resources.classify_calls(df), "fn_id", "rid", "kind") == [(0, "cache:k", "writes"), (2, "table:repo", "writes"), (3, "queue:box", "enqueues")]
    marks = spark.createDataFrame([("f", ["app.task(bind=True)", "CacheEvict('x')", "other"])], "fn_id string, decorators array<string>")
    assert rows(resources.classify_decorators(marks), "rtype", "kind") == [("cache", "writes"), ("queue", "consumes")]


def test_facts_supersede_within_a_kind(spark):
    facts = spark.createDataFrame([(1, "mechanism", 1), (2, "mechanism", 2), (3, "expectation", 3), (4, "mechanism", 4)], "fact_id int, kind string, ts long")
    cites = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "A")], "fact_id int, anchor string")
    assert rows(memory.supersede(facts, cites), "fact_id") == [(2,), (3,)]  # 4 cites nothing
    state = spark.createDataFrame([(1, "gone"), (1, "gone"), (2, "fresh"), (2, "gone"), (3, "fresh")], "fact_id int, state string")
    assert rows(memory.status(state), "fact_id", "status") == [(1, "gone"), (2, "stale"), (3, "active")]


def test_recall_falls_back_to_likeness(spark):
    facts = spark.createDataFrame([(1, "m", 1), (2, "m", 2)], "fact_id int, kind string, ts long")
    cites = spark.createDataFrame([(1, "A", "a.py"), (2, "B", "b.py")], "fact_id int, anchor string, file string")
    live = spark.createDataFrame([(1, "active"), (2, "stale")], "fact_id int, status string")
    none = spark.createDataFrame([], "anchor string"), spark.createDataFrame([], "file string")
    like = spark.createDataFrame([(1, 0.2), (2, 0.9)], "fact_id int, score double")
    assert rows(memory.recall(facts, cites, live, *none, likeness=like), "fact_id") == [(2,)]
    hit = spark.createDataFrame([("A",)], "anchor string")
    assert rows(memory.recall(facts, cites, live, hit, none[1], likeness=like), "fact_id") == [(1,)]


def test_coverage_and_mutations(spark):
    targets = spark.createDataFrame([(1, "S"), (2, "S"), (3, "T")], "id int, cls string")
    ran, seen = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([("com.x.S",)], "name string")
    assert rows(overlay.coverage(targets, ran, seen, True), "id", "status") == [(1, "executed"), (2, "instrumented"), (3, "not-instrumented")]
    assert {r["status"] for r in overlay.coverage(targets, ran, seen, False).collect()} == {"no-trace"}
    m = spark.createDataFrame([(None, "t", 1), (1, "t", 2), (9, "t", 3)], "anchor int, target string, n int")
    assert rows(overlay.kept_mutations(m, ran), "n") == [(1,), (2,)]


def test_merging_a_run_again_changes_nothing(spark):
    new = spark.createDataFrame([("r1", "a", "dev", 3)], "run_id string, q string, env string, n long")
    first = overlay.merge_once(spark.createDataFrame([], new.schema), new, ["q", "env"])
    assert rows(overlay.merge_once(first, new, ["q", "env"]), "run_id", "n") == [("r1", 3)]


def test_config_sources(spark):
    text = "# c\napp.mode=File\n! x\nb : 2\n"
    props = files.properties(spark.createDataFrame([("a.properties", text)], "path string, text string"))
    assert rows(props, "line", "key", "value") == [(2, "app.mode", "File"), (4, "b", "2")]
    assert files.flatten_yaml("a:\n  b: 1 # n\n  c:\n    - x\n  d: |\n    k: v\n  e: 'q'\nf: 2\n") == [(2, "a.b", "1"), (7, "a.e", "q"), (8, "f", "2")]
    code = spark.createDataFrame([("A.java", '@Value("${app.mode:x}") env.getProperty("b-c")'), ("b.py", "os.environ.get('Q_R')"), ("c.js", "process.env.Z `${no}`")], "path string, text string")
    assert rows(config.reads(code), "path", "norm_key") == [("A.java", "app.mode"), ("A.java", "b.c"), ("b.py", "q.r"), ("c.js", "z")]
    live = spark.createDataFrame([("app.mode", "LIVE"), ("b", "2"), ("zz", "1")], "norm_key string, value string")
    assert rows(config.divergence(live, props.select(fn.config_key(F.col("key")).alias("norm_key"), "value")), "norm_key", "value") == [("app.mode", "LIVE")]


def test_source_scan_and_parser(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("x")
    (tmp_path / "lib.min.js").write_text("x")
    (tmp_path / "wide.js").write_text("y" * 2001)
    (tmp_path / "svc.py").write_text("import os\nclass Service(Base):\n    @task\n    def handle(self):\n        return self.compute(os.getenv('A'))\n    def compute(self, x):\n        return x\nCONF = dict()\n")
    (tmp_path / "bad.py").write_text("def (:")
    found = files.readable(files.scan(spark, [str(tmp_path)]))
    assert sorted(r["path"] for r in found.collect()) == ["bad.py", "svc.py"]
    parsed = files.parse(found)
    assert rows(parsed.where("row = 'symbol'"), "qual", "type", "start", "end") == [("<module>", "module", 1, 9), ("Service", "class", 2, 7), ("Service.compute", "method", 6, 7), ("Service.handle", "method", 4, 5)]
    assert ("Service.handle", "self", "compute") in rows(parsed.where("row = 'call'"), "qual", "receiver", "name")
    assert parsed.where("qual = 'Service' AND row = 'symbol'").first()["bases"] == ["Base"]


def test_hunks():
    diff = "--- a/x.py\n+++ b/x.py\n@@ -3,2 +3,4 @@\n@@ -9,0 +12,2 @@\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,3 @@\n--- a/y.py\n+++ b/y.py\n@@ -5 +5 @@\n"
    assert files.hunks(diff) == [("x.py", 3, 4), ("x.py", 9, 9), ("y.py", 5, 5)]


def test_spans(spark):
    spans = spark.createDataFrame([("f", "a", 1, 10), ("f", "b", 2, 5), ("f", "c", 3, 6)], "file string, id string, start int, end int")
    assert rows(evaluation.overlapping(spark.createDataFrame([("f", 6, 7)], "file string, start int, end int"), spans), "id", "rank") == [("a", 2), ("c", 1)]


def test_traces_and_stream_agree(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    flush = lambda k, pid, hits: [json.dumps({"env": "e", "pid": pid, "qual": "q", "hits": hits, "flushed": k})]
    for i, lines in enumerate((flush(1, 1, 3), flush(2, 1, 5), flush(1, 2, 4))):
        (src / f"{i}.json").write_text("\n".join(lines))
    schema = "env string, pid long, qual string, hits long, flushed long"
    want = rows(stream.last_snapshots(spark.read.schema(schema).json(str(src))), "env", "qual", "hits")
    assert want == [("e", "q", 9)]
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = stream.start(live, "snapshots", str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert rows(spark.table("snapshots").groupBy("env", "qual").agg(F.sum("hits").alias("hits")), "env", "qual", "hits") == want
    q = stream.start_upserts(live, str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/v=2")).agg(F.sum("hits")).first()[0] == 9
    bad = tmp_path / "t.jsonl"
    bad.write_text('{"t":"method","qual":"S.h","hits":3}\nthis is not json\n[1]\n{"t":"class","name":"S"}\n')
    assert rows(files.traces(spark, str(bad)), "t") == [("class",), ("method",)]


def test_spans_are_grouped_where_they_meet(spark):
    from brackwater.operators import evaluation

    points = spark.createDataFrame([("f", 5), ("f", 40), ("g", 1)], "file string, line long")
    spans = spark.createDataFrame([("f", 1, 0, 100), ("f", 2, 4, 6), ("f", 3, 5, 7), ("g", 4, 2, 3)], "file string, id long, start long, end long")
    found = evaluation.smallest_enclosing(points.hint("merge"), spans)
    assert sorted(map(tuple, found.collect())) == [("f", 5, 2), ("f", 40, 1)]
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("ShuffleQueryStage") == 2  # the two sides of the join, and no third


def test_cochanges_take_as_many_tasks_as_their_pairs_call_for(spark, monkeypatch):
    from brackwater.operators import history

    monkeypatch.setattr(history, "TASK_ROWS", 10)
    touches = spark.createDataFrame([(c, f) for c in range(20) for f in range(5)] + [(0, 1)], "c long, f long")
    found = history.cochanges(touches, "c", "f")
    assert sorted(map(tuple, found.collect())) == [(a, b, 20) for a in range(5) for b in range(5) if a != b]
    assert "hashpartitioning(a#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 21), REPARTITION_BY_NUM" in plan  # 200 pairs


def test_couplings_send_a_function_once_for_many_partners(spark, monkeypatch):
    """A resource's readers once went to each of its tasks, which are as many as its pairs call for: bytes grew with the cube of its functions."""
    monkeypatch.setattr(resources, "PAIRS", 512)
    monkeypatch.setattr(resources, "BLOCK", 24)
    access = [("r", i, "writes") for i in range(400)] + [("r", i, "reads") for i in range(200, 700)] + [("s", 1, "reads"), ("s", 2, "reads"), ("t", 1, "writes"), ("t", 2, "reads")]
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext

    def sent():
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = sent()
    found = [tuple(r) for r in resources.couplings(spark.createDataFrame(access, "rid string, fn long, kind string")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {("r", w, r) for w in range(400) for r in range(200, 700) if w != r} | {("t", 1, 2)}
    assert sent() - before < 200_000


def test_couplings_rows_repeat_soon(spark, tmp_path):
    """Pairs that follow each other hold a few readers for each writer, so that Parquet's pages find them again."""
    access = spark.range(3000).select(F.lit("r").alias("rid"), F.col("id").alias("fn"), F.when(F.col("id") < 1000, "writes").otherwise("reads").alias("kind"))
    resources.couplings(access).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 500_000
