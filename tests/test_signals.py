"""Signals on small tables, by hand."""

from pyspark.sql import functions as F

from brackwater.operators import signals


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_fields_couple_writers_with_readers(spark):
    fields = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("a", 2, False), ("a", 2, False), ("b", 2, True), ("b", 3, False), ("c", 1, True), *[("hub", i, i == 1) for i in range(1, 20)]], "key string, fn long, writer boolean")
    assert rows(signals.field_sides(fields), "key", "fn", "writer") == [("a", 1, True), ("a", 2, False), ("b", 2, True), ("b", 3, False)]
    seeds = spark.createDataFrame([(1,)], "fn long")
    assert rows(signals.field_partners(fields, seeds), "fn") == [(2,)]
    assert len(rows(signals.field_partners(fields, seeds, None), "fn")) == 18
    assert signals.field_partners(fields.limit(0), seeds).count() == 0


def test_files_and_types_as_resources(spark):
    access = spark.createDataFrame([("r", "f1", "writes"), ("r", "f2", "reads"), ("s", "f1", "reads"), ("s", "f3", "reads"), ("r", "unknown", "reads")], "rid string, fn string, kind string")
    nodes = spark.createDataFrame([("f1", "A"), ("f2", "B"), ("f3", "A")], "id string, file string")
    shared = signals.file_resources(access, nodes)
    assert rows(shared, "rid", "file", "writes", "reads") == [("r", "A", True, False), ("r", "B", False, True)]
    assert rows(signals.shared_counts(shared, "A"), "file", "n") == [("B", 1)]
    refs = spark.createDataFrame([("T", "A"), ("T", "B"), ("One", "A"), *[("All", x) for x in "ABCDEF"], ("T", None)], "type string, file string")
    made = spark.createDataFrame([("T", "A")], "type string, file string")
    assert rows(signals.type_resources(refs, made, 6), "rid", "file", "writes", "reads") == [("type:T", "A", True, False), ("type:T", "B", False, True)]


def test_ranked_union_raises_by_signals_and_consensus(spark):
    content = spark.createDataFrame([(1, 0.0), (2, 4.0), (3, 2.0), (4, 0.0)], "id long, score double")
    legs = {"resource": spark.createDataFrame([(1,), (1,)], "id long"), "field": spark.createDataFrame([(1,)], "id long")}
    moved = spark.createDataFrame([(1, 2), (3, 4)], "id long, n long")
    got = signals.ranked_union(content, legs, moved, spark.createDataFrame([(2,)], "id long")).select("id", F.round("score", 6).alias("score"), "pooled")
    assert rows(got, "id", "score", "pooled") == [(1, 2.4, True), (2, 1.0, True), (3, 1.1, True), (4, 0.0, False)]
    flat = signals.ranked_union(content.withColumn("score", F.lit(3.0)), {}, moved.limit(0), moved.select("id").limit(0))
    assert rows(flat, "score", "pooled") == [(0.0, False)] * 4


def test_patterns_prefixes_and_siblings(spark):
    sites = spark.createDataFrame([("this.repo()", "save"), ("a.repo", "save"), (None, "run"), ("", "run")], "receiver string, method string")
    assert rows(signals.call_patterns(sites), "pattern", "n") == [("repo.save", 2), ("run", 2)]
    symbols = spark.createDataFrame([(["app.route('/a')", "app.route('/b')"],), (["cached"],), (None,)], "decorators array<string>")
    assert rows(signals.decorator_patterns(symbols), "decorator", "n") == [("app.route", 2), ("cached", 1)]
    files = spark.createDataFrame([("A.java", "// x\n package a.b.c;\n"), ("B.java", "package solo;"), ("C.java", None), ("D.py", "package a.z;"), ("E.java", " " * 2000 + "\npackage far.away;")], "path string, text string")
    assert rows(signals.package_prefixes(files), "prefix") == [("a.b",), ("solo",)]
    declared = spark.createDataFrame([("m1", "npm", "x"), ("m1", "npm", "x"), ("m2", "npm", "x"), ("m1", "go", "x")], "module string, ecosystem string, name string")
    modules = spark.createDataFrame([("m2", "npm", "x")], "module string, ecosystem string, name string")
    assert rows(signals.sibling_dependencies(declared, modules), "module", "sibling") == [("m1", "m2")]


def test_choices_by_group_and_configuration(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 9)], "g string, x long")
    assert rows(signals.first_seen(df, ["g"], ["x"]), "g", "x") == [("a", 1), ("b", 3), (None, 9)]
    touches = spark.createDataFrame([("f", True), ("f", False), ("f", None)], "file string, is_fix boolean")
    assert rows(signals.change_counts(touches), "file", "changes", "fixes") == [("f", 3, 1)]
    found = spark.createDataFrame([("lexical", 1, 10), ("lexical", 1, 11), ("other", 1, 99), ("other", 7, 1)], "config string, query long, id long")
    gold = spark.createDataFrame([(1, 10), (1, 12), (2, 5)], "query long, id long")
    assert rows(signals.recall_by_configuration(found, gold), "config", "macro", "micro", "size") == [("lexical", 0.25, 1 / 3, 1.0), ("other", 0.0, 0.0, 0.5)]
    pairs = spark.createDataFrame([("a", "b", 2), ("b", "a", 2), ("a", "c", 3), ("c", "a", 3), ("a", "d", 1), ("d", "a", 1)], "a string, b string, n long")
    assert rows(signals.cochange_gold(pairs), "query", "id") == [("a", "b"), ("a", "c")]
    defs = spark.createDataFrame([("k", "b", 1, "2"), ("k", "a", 5, "1"), ("z", "a", 1, "0")], "norm_key string, file string, line long, value string")
    reads = spark.createDataFrame([("k", "n1"), ("z", "n2"), ("gone", "n1")], "norm_key string, reader string")
    assert rows(signals.config_rows(defs, reads, spark.createDataFrame([("n1",)], "id string")), "norm_key", "file", "line", "value", "more") == [("k", "a", 5, "1", 1)]


def test_siblings_are_paired_without_bringing_pairs_together(spark):
    declared = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (2, "a", "x"), (3, None, "x"), (4, "b", "x")], "module long, ecosystem string, name string")
    modules = spark.createDataFrame([(2, "a", "x"), (2, "a", "y"), (5, "a", "y"), (6, None, "x"), (4, "b", "x"), (7, "b", "x")], "module long, ecosystem string, name string")
    found = signals.sibling_dependencies(declared, modules)
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 5), (4, 7)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [module" not in plan.split("Join")[0]  # nothing is grouped above the join


def test_a_resource_with_many_pairs_is_dealt_over_tasks(spark, monkeypatch):
    from brackwater.operators import resources

    monkeypatch.setattr(resources, "PAIRS", 100)
    monkeypatch.setattr(resources, "BLOCK", 16)
    rows = [("hot", f, k) for f in range(60) for k in (["writes", "reads"] if f % 3 == 0 else ["reads"])] + [("cold", 1, "writes"), ("cold", 2, "consumes"), ("alone", 1, "writes"), ("none", None, "reads"), ("none", 3, "writes")]
    found = resources.couplings(spark.createDataFrame(rows, "rid string, fn long, kind string"))
    made = [(part, r["rid"], r["writer"], r["reader"]) for part, these in enumerate(found.rdd.glom().collect()) for r in these]
    assert len({part for part, rid, *_ in made if rid == "hot"}) > 1
    assert sorted(x[1:] for x in made) == sorted([("hot", w, r) for w in range(0, 60, 3) for r in range(60) if w != r] + [("cold", 1, 2)])
    assert resources.couplings(spark.createDataFrame([], "rid string, fn long, kind string")).count() == 0
