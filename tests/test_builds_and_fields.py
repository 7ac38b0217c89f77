"""Modules of four ecosystems and their siblings; typed fields in four modes; values that flow through fields."""

from brackwater.operators import fields, signals
from brackwater.sources import builds

TREE = {
    "pom.xml": "<project><artifactId>shop</artifactId></project>",
    "core/pom.xml": "<project><parent><artifactId>shop</artifactId></parent>\n<artifactId> shop-core </artifactId></project>",
    "web/pom.xml": "<project><parent><artifactId>shop</artifactId></parent><artifactId>shop-web</artifactId><dependencies><dependency><artifactId>shop-core</artifactId></dependency></dependencies></project>",
    "ui/package.json": '{"name": "@shop/ui", "dependencies": {"@shop/lib": "1", "react": "18"}, "devDependencies": {"jest": "1"}}',
    "lib/package.json": '{"name": "@shop/lib"}', "broken/package.json": "{not json",
    "node_modules/x/package.json": '{"name": "x"}',
    "go.work": "use ./a", "a/go.mod": "module shop.io/a\n\nrequire shop.io/b v1.2.0\nrequire (\n\texample.com/z v0.1.0\n)\n", "b/go.mod": "module shop.io/b\n",
    "py/pyproject.toml": '[project]\nname = "Shop-Tools"\ndependencies = [\n  "shop-base>=1",\n  "numpy",\n]\n', "base/setup.py": "setup(name='shop-base', install_requires=['Shop-Tools[x]'])",
    "deep/one/two/build.gradle": "", "deep/one/build.gradle": "", "deep/settings.gradle": "", "web/src/main.java": "class A {}",
}


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_modules_of_four_ecosystems(spark):
    files = spark.createDataFrame(list(TREE.items()), "path string, text string")
    names = rows(builds.identities(files), "module", "ecosystem", "name")
    assert names == [("", "mvn", "shop"), ("a", "go", "shop.io/a"), ("b", "go", "shop.io/b"), ("base", "py", "shop-base"), ("core", "mvn", "shop-core"), ("lib", "js", "@shop/lib"), ("py", "py", "shop-tools"), ("ui", "js", "@shop/ui"), ("web", "mvn", "shop-web")]
    assert ("node_modules/x",) not in rows(builds.modules(files), "dir") and ("broken",) in rows(builds.modules(files), "dir")
    needs = builds.declared(files)
    assert {("ui", "js", "react"), ("ui", "js", "jest"), ("a", "go", "example.com/z"), ("py", "py", "numpy")} <= set(rows(needs, "module", "ecosystem", "name"))
    assert {("a", "b"), ("base", "py"), ("py", "base"), ("ui", "lib"), ("web", "core"), ("web", ""), ("core", "")} == set(rows(signals.sibling_dependencies(needs, builds.identities(files)), "module", "sibling"))


def test_roots(spark):
    files = spark.createDataFrame([(k, v) for k, v in TREE.items() if k not in ("pom.xml", "go.work")], "path string, text string")
    dirs = spark.createDataFrame([("deep/one/two",), ("web/src",), ("web",), ("a",), ("",)], "dir string")
    assert rows(builds.project_roots(dirs, files), "dir", "root") == [("", ""), ("a", "a"), ("deep/one/two", "deep"), ("web", "web"), ("web/src", "web")]
    whole = spark.createDataFrame(list(TREE.items()), "path string, text string")
    assert dict(rows(builds.project_roots(dirs, whole), "dir", "root"))["a"] == ""


FUNCTIONS = [
    ("f1", "A.java", "Cart", "order.total = 3; if (order.state == 1) this.count += 2; order.load(x); order.MAX = 1;"), ("f2", "B.java", "Mail", "use(o.total); o.total = o.total + 1; name.size = 2;"),
    ("f3", "B.java", "Mail", "print(o.total, name.length, o.state)"), ("f4", "A.java", "Cart", "return this.count;"), ("f5", "C.java", "X", None), ("f6", "A.java", "Cart", "base.flag = base.other; i++; --j; k = i;"),
]
VARIABLES = [("A.java", "order", "Order"), ("B.java", "o", "Order"), ("B.java", "name", "String"), ("A.java", "base", "BaseThing")]


def test_fields_in_four_modes(spark):
    functions, variables = spark.createDataFrame(FUNCTIONS, "fn string, file string, cls string, text string"), spark.createDataFrame(VARIABLES, "file string, name string, type string")
    found = lambda mode: {(k, f): w for k, f, w in rows(fields.field_accesses(functions, variables, mode), "key", "fn", "writer")}
    typed = {("Order.total", "f1"): True, ("Cart.count", "f1"): True, ("Order.total", "f2"): True, ("Order.total", "f3"): False, ("Order.state", "f3"): False, ("Cart.count", "f4"): False}
    assert found("filtered") == typed
    assert found("full") == typed | {("String.size", "f2"): True, ("String.length", "f3"): False, ("BaseThing.flag", "f6"): True, ("BaseThing.other", "f6"): False}
    assert found("name")["total", "f3"] is False and found("name")["size", "f2"] is True and ("MAX", "f1") not in found("name")
    every = found("allvars")
    assert every["flag", "f6"] and not every["other", "f6"] and every["total", "f2"] and ("this", "f4") not in every
    sides = signals.field_sides(fields.field_accesses(functions, variables))
    assert rows(sides, "key", "fn") == [("Cart.count", "f1"), ("Cart.count", "f4"), ("Order.total", "f1"), ("Order.total", "f2"), ("Order.total", "f3")]


def test_values_flow_through_fields(spark):
    body = spark.createDataFrame([("Order", "class Order { private int total; protected final String name = x; public static Logger log; int bare; private Map<String, Item> ids; }"), ("None", None)], "type string, text string")
    declared = fields.fields_of_types(body)
    assert rows(declared, "type", "field") == [("Order", "name"), ("Order", "total")]  # the pattern takes types of one word
    refs = spark.createDataFrame([("Order", "A", "o.setTotal(3)"), ("Order", "B", "return o.getTotal() + o.name.trim()"), ("Order", "A", "o.name == x"), ("Order", "C", "o.total = 1; y = o.total"), ("Order", "D", "ids")], "type string, file string, text string")
    assert rows(fields.value_flow(declared, refs), "rid", "file", "writes", "reads") == [("field:Order.total", "A", True, False), ("field:Order.total", "B", False, True), ("field:Order.total", "C", True, False)]


def test_value_flow_makes_patterns_for_rows_that_may_match_alone(spark):
    declared = spark.createDataFrame([("T", "size"), ("T", "rate")], "type string, field string")
    refs = spark.createDataFrame([("T", "a", "t.setSize(1);"), ("T", "b", "x = t.isSize();"), ("T", "c", "t.size = 2;"), ("T", "d", "y = t.rate"), ("T", "e", "t.getRate()"), ("T", "f", "size and rate")], "type string, file string, text string")
    found = fields.value_flow(declared, refs)
    assert sorted(map(tuple, found.collect())) == [("field:T.rate", "d", False, True), ("field:T.rate", "e", False, True), ("field:T.size", "a", True, False), ("field:T.size", "b", False, True), ("field:T.size", "c", True, False)]
    assert "Contains(text" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) or "substring(field" in plan
