"""Facts over two sessions, anchors of citations, and a stream's keyed state."""

import json

from pyspark.sql import functions as F

from brackwater.operators import memory
from brackwater.store import BucketStore
from brackwater.streaming import overlay as stream

SYMBOLS = "id string, file string, qual string, name string, start int, end int"
SOURCE = "class Order:\n    def total(self):\n        return 1\n\ndef total():\n    return 2\n"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def program(spark, source=SOURCE):
    symbols = spark.createDataFrame([("a.py::<module>", "a.py", "<module>", "<module>", 1, 6), ("a.py::Order", "a.py", "Order", "Order", 1, 3), ("a.py::Order.total", "a.py", "Order.total", "total", 2, 3), ("a.py::total", "a.py", "total", "total", 5, 6), ("b.py::Cart.Item.add", "b.py", "Cart.Item.add", "add", 1, 1)], SYMBOLS)
    keys = spark.createDataFrame([("cache.type", "app.yml", 3, "redis"), ("cache.type", "b.yml", 1, "none")], "norm_key string, file string, line int, value string")
    return symbols, keys, spark.createDataFrame([("a.py", source), ("b.py", "add")], "path string, text string")


def test_citations_mean_the_first_that_fits(spark):
    cited = ["a.py::Order", "a.py:2", "a.py:1", "Order.total", "total", "Item.add", "CACHE_TYPE", "nowhere", "z.py:4"]
    found = memory.anchors_of(spark.createDataFrame([("f", c) for c in cited], "fact_id string, citation string"), *program(spark))
    assert {r["citation"]: r["anchor"] for r in found.collect()} == {
        "a.py::Order": "a.py::Order", "a.py:2": "a.py::Order.total", "a.py:1": "a.py::Order", "Order.total": "a.py::Order.total", "total": "a.py::total", "Item.add": "b.py::Cart.Item.add", "CACHE_TYPE": "config::cache.type",
    }
    assert all(r["hash"] for r in found.collect())


def test_facts_outlive_a_session(spark, tmp_path):
    root, code = f"file://{tmp_path}/memory", program(spark)
    tell = lambda facts, cites, now=code: memory.Memory(spark, root, buckets=4).remember(spark.createDataFrame(facts, memory.FACTS), memory.anchors_of(spark.createDataFrame(cites, "fact_id string, citation string"), *now))
    assert tell([("1", "expectation", "total is cached", 10), ("2", None, "orders add up", 11), ("3", "expectation", "cites nothing", 12)], [("1", "Order.total"), ("1", "cache.type"), ("2", "Order"), ("3", "nowhere")]) == {"remembered": 2, "dropped": 1, "replaced": 0}
    assert rows(memory.Memory(spark, root, buckets=4).facts(), "fact_id", "kind") == [("1", "expectation"), ("2", "mechanism")]
    # Another session replaces the first fact by any anchor that both cite; the second is of another kind.
    assert tell([("4", "expectation", "total is not cached", 20)], [("4", "Order.total"), ("4", "Order")]) == {"remembered": 1, "dropped": 0, "replaced": 1}
    later = memory.Memory(spark, root, buckets=4)
    assert rows(later.facts(), "fact_id") == [("2",), ("4",)] and rows(later.citations(), "fact_id", "anchor") == [("2", "a.py::Order"), ("4", "a.py::Order"), ("4", "a.py::Order.total")]
    # The method's lines change: the class around it and itself are stale; nothing is gone.
    changed = program(spark, SOURCE.replace("return 1", "return 3"))
    every = spark.createDataFrame([("x", r["id"]) for r in changed[0].collect()], "fact_id string, citation string")
    now = memory.anchors_of(every, *changed).select("anchor", "hash")
    asked = lambda a, **k: [(r["fact_id"], r["status"]) for r in later.recall(now, spark.createDataFrame([(a,)], "anchor string"), spark.createDataFrame([], "file string"), **k).collect()]
    assert asked("a.py::Order") == [("4", "stale"), ("2", "stale")] and asked("a.py::Order", kind="expectation") == [("4", "stale")] and asked("a.py::total") == []
    now = now.where("anchor <> 'a.py::Order'")
    assert asked("a.py::Order.total") == [("4", "stale")] and asked("a.py::Order") == [("4", "stale")]  # all that the second one cites is gone


def test_a_streams_state(spark, tmp_path):
    src, root, mark = tmp_path / "in", f"file://{tmp_path}/state", str(tmp_path / "checkpoint")
    src.mkdir()
    schema = "env string, pid long, qual string, hits long, flushed long"
    flush = lambda name, *lines: (src / name).write_text("\n".join(json.dumps(dict(zip(("env", "pid", "qual", "hits", "flushed"), x, strict=True))) for x in lines))

    def run():
        q = stream.start_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), root, mark, buckets=8)
        q.awaitTermination(120)
        assert rows(stream.state_totals(spark, root), "env", "qual", "hits") == rows(stream.last_snapshots(spark.read.schema(schema).json(str(src))), "env", "qual", "hits")

    flush("0.json", ("dev", 1, "q", 3, 1), ("dev", 2, "q", 5, 1), ("prod", 1, "r", 1, 9))
    flush("1.json", ("dev", 1, "q", 8, 4))
    run()
    before = BucketStore(spark, root).manifest()[1]["state"]
    flush("2.json", ("dev", 1, "q", 4, 2))  # out of order: an earlier flush
    flush("3.json", ("dev", 1, "q", 8, 4), ("dev", 1, "s", 2, 4))  # again, and something new
    run()
    store = BucketStore(spark, root)
    after = store.manifest()[1]["state"]
    assert sum(after[b] != before[b] for b in before) == 1 and len(store.versions()) == 2  # one process' bucket was written
    assert rows(stream.state(spark, root).where("pid = 1 AND env = 'dev'"), "qual", "hits") == [("q", 8), ("s", 2)]
    assert store.manifest()[2]["batch"] == 3
