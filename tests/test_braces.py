"""Languages with braces against a plain loop, and imports between their files."""

import re

import numpy as np

from brackwater.operators import program
from brackwater.sources import braces, files

JAVA = '''package com.shop.order;

import com.shop.mail.Sender;
import static com.shop.util.Texts.trim;
import com.shop.cart.*;

/** Orders { with a brace in a comment */
@Service("orders")
public class OrderService extends Base<Order> implements Closeable, shop.Auditable {
    private final OrderRepo repo;
    private Map<String, Item> items = new HashMap<>();

    @Transactional
    @Cacheable(value = "order { }")
    public Order load(String id, int n) throws IOException {
        if (id == null) {
            throw new IllegalStateException("none }");
        }
        // a brace } in a line
        repo.save("key", id);
        return helper(id).trim();
    }

    static class Inner {
        void run() { queue.publish('topic'); }
    }

    interface Hook { }
}
'''
SCRIPT = '''import { a } from './lib/a';
import b from "../b";
const c = require('./c');
export class Cart extends Basket {
  add(item) {
    const price = (x) => { return x.price(); };
    this.items.push(item);
  }
}
function total(cart) {
  for (const i of cart) { sum(i); }
}
const later = async (x) => {
  await send("later");
};
let note: Note = null;
'''
GO = '''package main

import (
	"fmt"
	"shop/cart"
)

type Order struct {
	id int
}

func (o *Order) Total(n int) int {
	fmt.Println("total")
	return n
}

func main() {
	run()
}
'''


def parsed(spark, *pairs):
    return files.parse(spark.createDataFrame(pairs, "path string, text string"))


def symbols(rows, path):
    return sorted((r["qual"], r["type"], r["start"], r["end"], r["parent"]) for r in rows if r["path"] == path and r["row"] == "symbol" and r["type"] != "module")


def test_java(spark):
    rows = parsed(spark, ("a/OrderService.java", JAVA)).collect()
    assert symbols(rows, "a/OrderService.java") == [
        ("OrderService", "class", 9, 29, "<module>"), ("OrderService.Hook", "class", 28, 28, "OrderService"), ("OrderService.Inner", "class", 24, 26, "OrderService"),
        ("OrderService.Inner.run", "method", 25, 25, "OrderService.Inner"), ("OrderService.load", "method", 15, 22, "OrderService"),
    ]
    by_name = {r["name"]: r for r in rows if r["row"] == "symbol"}
    assert by_name["OrderService"]["bases"] == ["Base", "Closeable", "Auditable"] and by_name["OrderService"]["decorators"] == ['Service("orders")']
    assert by_name["load"]["decorators"] == ["Transactional", 'Cacheable(value = "order { }")'] and by_name["run"]["decorators"] == []
    calls = {(r["qual"], r["receiver"], r["name"], r["arg0"]) for r in rows if r["row"] == "call"}
    assert {("OrderService.load", "repo", "save", '"key"'), ("OrderService.load", "", "helper", "id"), ("OrderService.Inner.run", "queue", "publish", "'topic'")} <= calls
    assert {r["arg0"] for r in rows if r["row"] == "import"} == {"com.shop.mail.Sender", "com.shop.util.Texts.trim", "com.shop.cart.*"}
    assert {("repo", "OrderRepo"), ("items", "Map"), ("id", "String")} <= {(r["name"], r["arg0"]) for r in rows if r["row"] == "variable"}


def test_scripts_and_go(spark):
    rows = parsed(spark, ("x/y/s.ts", SCRIPT), ("m.go", GO), ("e.js", ""), ("n.js", None)).collect()
    assert [s[:2] for s in symbols(rows, "x/y/s.ts")] == [("Cart", "class"), ("Cart.add", "method"), ("Cart.add.price", "function"), ("later", "function"), ("total", "function")]
    assert {r["arg0"] for r in rows if r["row"] == "import"} == {"./lib/a", "../b", "./c", "fmt", "shop/cart"}
    assert {("later", "send", '"later"'), ("total", "sum", "i"), ("Cart.add", "push", "item"), ("Cart.add.price", "price", None)} <= {(r["qual"], r["name"], r["arg0"]) for r in rows if r["row"] == "call"}
    assert ("note", "Note") in {(r["name"], r["arg0"]) for r in rows if r["row"] == "variable"}
    assert symbols(rows, "m.go") == [("Order", "class", 8, 10, "<module>"), ("Total", "function", 12, 15, "<module>"), ("main", "function", 17, 19, "<module>")]
    assert sorted(r["path"] for r in rows if r["type"] == "module") == ["e.js", "m.go", "n.js", "x/y/s.ts"]


def nested(rng, depth, names):
    lines = []
    for _ in range(int(rng.integers(1, 4))):
        k = rng.random()
        pad = "  " * depth
        if k < 0.35 and depth < 6:
            lines += [f"{pad}class {next(names)} {{", *nested(rng, depth + 1, names), pad + "}"]
        elif k < 0.7 and depth:
            lines += [f"{pad}void {next(names)}(int a) {{", *(nested(rng, depth + 1, names) if depth < 6 else []), pad + "}"]
        elif k < 0.85 and depth:
            lines += [pad + "if (a) {", *(nested(rng, depth + 1, names) if depth < 6 else []), pad + "}"]
        else:
            lines.append(f'{pad}call("}}"); // {{')
    return lines


def plain(text):
    """Symbols by one walk over the lines, with a stack."""
    stack, out = [], []
    for no, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if m := re.match(r"(?:class|void) (\w+)", line):
            named = [n for n, _ in stack if n]
            stack.append((m[1], len(out)))
            out.append([".".join([*named, m[1]]), no, None, ".".join(named) or "<module>"])
        elif line.startswith("if"):
            stack.append((None, None))
        elif line == "}":
            if (at := stack.pop()[1]) is not None:
                out[at][2] = no
    return sorted(map(tuple, out))


def test_nesting_matches_a_plain_walk(spark):
    rng = np.random.default_rng(12)
    texts = {f"f{i}.java": "\n".join(nested(rng, 0, (f"N{i}x{k}" for k in range(10_000)))) for i in range(30)}
    rows = braces.parse(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()
    for path, text in texts.items():
        assert sorted((r["qual"], r["start"], r["end"], r["parent"]) for r in rows if r["path"] == path and r["type"] in ("class", "method", "function")) == plain(text), text


def test_imports_resolve(spark):
    texts = {
        "src/lib/u.py": "", "src/app/m.py": "import lib.u\nfrom . import n\nfrom lib.u import f", "src/app/n.py": "import two.same", "p/two/same.py": "", "q/two/same.py": "", "pkg/__init__.py": "", "top.py": "import pkg.thing",
        "a/b/x.js": "import z from '../../c';\nimport y from './././y';\nimport r from 'react';", "c.js": "", "a/b/y/index.ts": "",
        "j/A.java": "package com.x;\nimport com.y.B;\nimport com.y.B.Inner;\nimport static com.z.C.f;\nimport com.w.*;\nclass A {}", "j/B.java": "package com.y;\nclass B {}", "j/C.java": "package com.z;\nclass C {}", "j/D.java": "package com.w;\nclass D {}", "j/E.java": "package com.w;\nimport com.w.E;\nclass E {}",
    }
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = sorted(map(tuple, program.import_edges(files.parse(df), df).collect()))
    assert got == [
        ("a/b/x.js", "a/b/y/index.ts"), ("a/b/x.js", "c.js"), ("j/A.java", "j/B.java"), ("j/A.java", "j/C.java"), ("j/A.java", "j/D.java"), ("j/A.java", "j/E.java"), ("src/app/m.py", "src/app/n.py"), ("src/app/m.py", "src/lib/u.py"), ("top.py", "pkg/__init__.py"),
    ]
