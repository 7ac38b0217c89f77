"""The index of a small tree, and of this repository's own sources."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brackwater.operators import program, resources, state
from brackwater.sources import files

TREE = {
    "pkg/__init__.py": "",
    "pkg/svc.py": "from pkg.conf import Conf\nfrom . import util\nimport os\n\nclass Base:\n    pass\n\nclass Service(Base):\n    conf: Conf = None\n    def handle(self, x):\n        redis.set('user:1', x)\n        return self.compute(x)\n    def compute(self, x):\n        return Conf(x)\n",
    "pkg/conf.py": "class Conf:\n    def get(self, k):\n        return redis.hget('user:1', k)\n\nclass Service:\n    pass\n\nclass Child(Service):\n    pass\n",
    "pkg/util.py": "import pkg.svc\n\ndef run(s):\n    s.compute(1)\n    s.compute(2)\n\nrun(None)\n",
    "build/skipped.py": "def no(): pass\n",
}


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tree") / "build"  # a project may lie in a folder of any name
    for name, text in TREE.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    found = files.scan(spark, [str(top)])
    assert rows(found, "path") == sorted((n,) for n in TREE if not n.startswith("build/"))
    return found.cache()


@pytest.fixture(scope="module")
def index(tree):
    return {k: v.cache() for k, v in program.build_index(files.parse(tree), tree).items()}


def test_edges(index, spark, tmp_path):
    assert ("pkg/svc.py::Service", "pkg/svc.py::Service.handle") in rows(index["contains"], "parent", "child") and ("pkg/svc.py::<module>", "pkg/svc.py::Base") in rows(index["contains"], "parent", "child")
    assert rows(index["inherits"], "child", "parent") == [("pkg/conf.py::Child", "pkg/conf.py::Service"), ("pkg/conf.py::Child", "pkg/svc.py::Service"), ("pkg/svc.py::Service", "pkg/svc.py::Base")]
    assert rows(index["imports"], "src", "dst") == [("pkg/svc.py", "pkg/conf.py"), ("pkg/svc.py", "pkg/util.py"), ("pkg/util.py", "pkg/svc.py")]
    calls = rows(index["calls"], "fn_id", "method")
    assert ("pkg/util.py::<module>", "run") in calls and calls.count(("pkg/util.py::run", "compute")) == 2
    program.write_index(index, str(tmp_path / "index"))
    back = program.read_index(spark, str(tmp_path / "index"), list(index))
    assert all(rows(back[k].select(F.to_json(F.struct("*")).alias("x")), "x") == rows(v.select(F.to_json(F.struct("*")).alias("x")), "x") for k, v in index.items())
    assert dict(rows(program.type_counts(index["nodes"]), "type", "n"))["class"] == 5 and program.dominant_language(index["nodes"]) == "py"


def test_targets_resolve_in_order(index):
    for target, want in (("pkg/svc.py::Service.handle", ["pkg/svc.py::Service.handle"]), ("./pkg/svc.py:11", ["pkg/svc.py::Service.handle"]), ("Service", ["pkg/conf.py::Service", "pkg/svc.py::Service"]), ("compute", ["pkg/svc.py::Service.compute"]), ("run", ["pkg/util.py::run"]), ("nothing", [])):
        assert [x for (x,) in rows(program.resolve(index["nodes"], target), "id")] == want, target


def test_impact_takes_the_first_relation(index, spark):
    access = resources.classify_calls(index["calls"]).select(F.col("fn_id").alias("fn"), "rid", "kind")
    assert rows(access, "fn", "rid", "kind") == [("pkg/conf.py::Conf.get", "cache:user:1", "reads"), ("pkg/svc.py::Service.handle", "cache:user:1", "writes")]
    seen = spark.createDataFrame([("pkg/util.py::run", "pkg/svc.py::Service.compute")], "caller string, callee string")
    found = program.impact(index["nodes"], index["calls"], access, program.resolve(index["nodes"], "Service.handle"), seen)
    assert rows(found, "id", "relation") == [("pkg/conf.py::Conf.get", "downstream"), ("pkg/svc.py::Service.compute", "sibling")]
    found = program.impact(index["nodes"], index["calls"], access, program.resolve(index["nodes"], "Service.compute"), seen)
    assert rows(found, "id", "relation") == [("pkg/svc.py::Service.handle", "sibling"), ("pkg/util.py::run", "runtime-caller")]
    pairs = resources.cross_file(resources.couplings(resources.in_product_code(access, index["nodes"])), index["nodes"])
    assert rows(pairs, "writer", "reader", "cross") == [("pkg/svc.py::Service.handle", "pkg/conf.py::Conf.get", True)]


def test_state_types(index, tree, spark):
    text = F.array_join(F.slice(F.split("text", "\n"), F.col("start"), F.col("end") - F.col("start") + 1), "\n")
    nodes = index["nodes"].join(tree.select(F.col("path").alias("file"), "text"), "file").withColumn("text", text).cache()
    uses, made = state.references(nodes), state.producers(nodes)
    assert ("Conf", "pkg/svc.py::Service.compute") in rows(uses, "type", "node") and ("Conf", "pkg/svc.py::Service.compute") in rows(made, "type", "node")
    none = spark.createDataFrame([], "id string")
    got = rows(state.lineage(spark.createDataFrame([("Conf",)], "type string"), nodes, index["inherits"], index["contains"], uses, made, none), "id")
    assert ("pkg/conf.py::Conf.get",) in got and ("pkg/svc.py::Service.compute",) in got and ("pkg/util.py::run",) not in got
    assert rows(state.candidates(nodes), "type")[0] == ("Base",)
    held = spark.createDataFrame([("pkg/svc.py::Service.handle", "cache", ["Conf"])], "id string, kind string, types array<string>")
    assert rows(state.implied(nodes, uses, held, "stale cache", [], [], none), "type") == [("Conf",)]
    assert rows(state.implied(nodes, uses, held, "rename it", ["Child"], [], none), "type") == [("Child",)]


def test_tickets_and_mutations(spark):
    commits = spark.createDataFrame([(["12"], ["a.py", "tests/b.py"]), (["12", "AB-1"], ["a.py", "c.py"]), (["AB-1"], ["c.py"])], "tickets array<string>, files array<string>")
    assert rows(program.ticket_file(commits, "#12"), "file", "n") == [("a.py", 2)] and rows(program.ticket_file(commits, "AB-1"), "file") == [("c.py",)]
    seen = spark.createDataFrame([("f", "k", "write"), ("g", "k2", "write"), ("r", "k", "read"), ("r", "k2", "read"), ("h", "k2", "write")], "anchor string, target string, op string")
    calls = spark.createDataFrame([("f", "g")], "caller string, callee string")
    assert rows(program.mutation_reach(seen, spark.createDataFrame([("f",)], "id string"), calls), "target", "writer", "reader") == [("k", "f", "r"), ("k2", "g", "r")]


def test_own_sources_are_indexed(spark):
    top = Path(__file__).resolve().parents[1]
    found = files.scan(spark, [str(top)])
    index = program.build_index(files.parse(found), found)
    assert index["nodes"].where("type = 'function'").count() > 150
    assert ("brackwater/operators/program.py",) in rows(index["imports"].select("src"), "src")


def test_decorators_and_receivers(spark):
    marks = spark.createDataFrame([("f", "onOrder", ["KafkaListener(topics = 'x.y')", "Override"]), ("g", "price", ["org.cache.Cacheable", "CacheEvict(\"p.q\")"]), ("h", "tick", ["Scheduled(cron = \"a.b\")"])], "fn_id string, name string, decorators array<string>")
    assert rows(resources.classify_decorators(marks), "fn_id", "rid", "kind") == [("f", "queue:x.y", "consumes"), ("g", "cache:p.q", "writes"), ("g", "cache:price", "reads"), ("h", "queue:a.b", "consumes")]
    calls = spark.createDataFrame([(1, "this.userRepo", "save", "x", None), (2, "app.conn.redis", "hget", "'k'", None), (3, "ctx.getRepository()", "save", "x", None), (4, "kafka.template()", "send", "x", None)], "fn_id int, receiver string, method string, arg0 string, type string")
    assert rows(resources.classify_calls(calls), "fn_id", "rid") == [(1, "table:userrepo"), (2, "cache:k"), (3, "table:getrepository"), (4, "queue:template")]
    assert resources.merged_rules({"db_write_attrs": ["Store"], "cache_read": ["peek"]})["db_write"][-1] == "store"
