"""Source trees, configuration files, diffs and traces as tables."""

from __future__ import annotations

import ast
import datetime
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.sources import braces
from brackwater.storage import ship

EXTENSIONS = ("py", "pyi", "java", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go")
# Folders that are not scanned, and files that are not read.
SKIPPED_DIRS = (".git", "node_modules", ".venv", "venv", "build", "dist", "__pycache__", ".tox", ".mypy_cache", "site-packages")
VENDORED_DIRS = ("vendor", "bower_components", "node_modules", "third_party")
MINIFIED = (".min.js", ".min.ts", ".bundle.js")
LONGEST_LINE = 2000
TRACE = "t STRING, profile STRING, mode STRING, env STRING, qual STRING, hits BIGINT, caller STRING, callee STRING, n BIGINT, samples ARRAY<STRUCT<v: STRING, n: BIGINT>>, name STRING, node STRING, kind STRING, target STRING, op STRING, before STRING, after STRING, bad STRING"


def scan(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path (below its root), root, mtime, size, text, bad of the files below the roots, each once; undecodable bytes are dropped, and bad marks files that had any.
    Contents are read of files with the wanted extensions only; folders are skipped by their names below the root, wherever the root itself lies. Spark's readers pass over names that
    begin with an underscore, such as __init__.py; of local roots the driver adds those files."""
    pattern = "*.{" + ",".join(sorted({x for e in extensions for x in (e, e.upper())})) + "}"
    rows = None
    for root in roots:
        top = root.rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(top)
        bare = F.regexp_replace("path", r"^[a-z][a-z0-9+.\-]*:/+", "/")
        start = _below(top)
        below = bare.substr(F.instr(bare, start) + len(start), F.length(bare))
        leg = files.select(F.col("path").alias("full"), below.alias("path"), F.lit(top).alias("root"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
        rows = leg if rows is None else rows.unionByName(leg)
        if more := _underscored(start, extensions):
            rows = rows.unionByName(spark.createDataFrame([(*m[:2], top, *m[2:]) for m in more], rows.schema))
    wanted = ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_DIRS)))
    kept = rows.where(wanted).dropDuplicates(["full"]).drop("full")
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    return kept.select("path", "root", "mtime", "size", F.translate(valid, "\ufffd", "").alias("text"), (valid.contains("\ufffd") & ~F.col("content").cast("string").contains("\ufffd")).alias("bad"))


def _below(root: str) -> str:
    """A root without its scheme, with a slash at its end."""
    return re.sub(r"^[a-z][a-z0-9+.\-]*:/+", "/", root).rstrip("/") + "/"


def _underscored(root: str, extensions: tuple[str, ...]) -> list[tuple]:
    """full path, path, time, size and content of a local root's files whose names, or whose folders' names, begin with an underscore."""
    found = []
    for folder, subs, names in os.walk(root):
        subs[:] = [x for x in subs if x not in SKIPPED_DIRS]
        under = any(x.startswith("_") for x in os.path.relpath(folder, root).split(os.sep))
        for name in names:
            if (under or name.startswith("_")) and name.rpartition(".")[2].lower() in extensions:
                full = os.path.join(folder, name)
                with open(full, "rb") as f:
                    found.append((full, os.path.relpath(full, root).replace(os.sep, "/"), datetime.datetime.fromtimestamp(os.path.getmtime(full)), os.path.getsize(full), f.read()))
    return found


def readable(files: DataFrame) -> DataFrame:
    """Files that people wrote: not minified, not vendored, no line over LONGEST_LINE."""
    ends = F.lit(False)
    for e in MINIFIED:
        ends = ends | F.col("path").endswith(e)
    vendored = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, VENDORED_DIRS)))
    longest = F.array_max(F.transform(F.split("text", "\n"), F.length))
    return files.where(~ends & ~vendored & (F.coalesce(longest, F.lit(0)) <= LONGEST_LINE))


def properties(files: DataFrame) -> DataFrame:
    """path, line, key, value (120 characters at most) of `key = value` lines; # and ! start comments. files: path, text."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("i", "x"))
    pattern = r"^\s*([A-Za-z0-9_.\-]+)\s*[=:]\s*(.*?)\s*$"
    found = lines.where(~F.ltrim("x").rlike("^[#!]") & F.col("x").rlike(pattern))
    return found.select("path", (F.col("i") + 1).alias("line"), F.regexp_extract("x", pattern, 1).alias("key"), F.substring(F.regexp_extract("x", pattern, 2), 1, 120).alias("value"))


def flatten_yaml(text: str) -> list[tuple[int, str, str]]:
    """line, dotted key, value of scalar entries; list items, block scalars and anchors are skipped."""
    out, stack, block = [], [], None
    for no, raw in enumerate(text.splitlines(), 1):
        body = raw.strip()
        depth = len(raw) - len(raw.lstrip(" "))
        if block is not None:
            if not body or depth > block:
                continue
            block = None
        if not body or body[0] in "#-&*" or body.startswith("---") or ":" not in body:
            continue
        key, _, value = body.partition(":")
        if value and not value[0].isspace():
            continue
        key, value = key.strip().strip("\"'"), value.split(" #")[0].strip()
        while stack and stack[-1][0] >= depth:
            stack.pop()
        path = ".".join([*(k for _, k in stack), key])
        if not value:
            stack.append((depth, key))
        elif value[0] in "|>":
            block = depth
        elif value[0] not in "&*":
            out.append((no, path, value.strip("\"'")[:120]))
    return out


def yaml_entries(files: DataFrame) -> DataFrame:
    """path, line, key, value of YAML files, one file at a time."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *e) for p, t in zip(b["path"], b["text"], strict=True) for e in flatten_yaml(t or "")], columns=["path", "line", "key", "value"])

    ship(files.sparkSession)
    return files.select("path", "text").mapInPandas(parse, "path string, line int, key string, value string")


def hunks(diff: str) -> list[tuple[str, int, int]]:
    """file, start, end on the old side of a unified diff; a pure insertion is anchored at the line before it, new files are skipped."""
    out, file = [], None
    for line in diff.splitlines():
        if line.startswith("--- "):
            file = None if line[4:].startswith("/dev/null") else line[4:].removeprefix("a/").split("\t")[0]
        elif line.startswith("@@") and file:
            old = line.split()[1].removeprefix("-").split(",")
            start, n = int(old[0]), int(old[1]) if len(old) > 1 else 1
            out.append((file, start if n else max(1, start), start + n - 1 if n else max(1, start)))
    return out


def gold_spans(diffs: DataFrame) -> DataFrame:
    """id, file, start, end. diffs: id, diff."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *h) for i, d in zip(b["id"], b["diff"], strict=True) for h in hunks(d or "")], columns=["id", "file", "start", "end"])

    ship(diffs.sparkSession)
    return diffs.select("id", "diff").mapInPandas(parse, "id string, file string, start int, end int")


def python_rows(path: str, text: str) -> list[dict]:
    """Symbols, calls and imports of a Python file; none of one that can't be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    rows = [{"row": "symbol", "qual": "<module>", "type": "module", "start": 1, "end": max(1, text.count("\n") + 1), "name": "<module>"}]
    tail = lambda e: ast.unparse(e).split(".")[-1].split("(")[0]

    def walk(node: ast.AST, scope: list[str], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            here = ".".join(scope) or "<module>"
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(child, ast.ClassDef)
                rows.append({
                    "row": "symbol", "qual": ".".join([*scope, child.name]), "type": "class" if is_class else "method" if in_class else "function", "start": child.lineno, "end": child.end_lineno, "name": child.name,
                    "parent": here, "bases": list(dict.fromkeys(tail(b) for b in child.bases)) if is_class else [], "decorators": [ast.unparse(d) for d in child.decorator_list],
                })
                walk(child, [*scope, child.name], is_class)
                continue
            if isinstance(child, ast.Call):
                receiver = ast.unparse(child.func.value) if isinstance(child.func, ast.Attribute) else ""
                method = child.func.attr if isinstance(child.func, ast.Attribute) else child.func.id if isinstance(child.func, ast.Name) else ""
                if method:
                    rows.append({"row": "call", "qual": here, "receiver": receiver, "name": method, "arg0": ast.unparse(child.args[0])[:120] if child.args else None, "start": child.lineno})
            elif isinstance(child, ast.Import):
                rows.extend({"row": "import", "qual": here, "name": a.asname or a.name, "arg0": a.name, "start": child.lineno} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.extend({"row": "import", "qual": here, "name": a.asname or a.name, "arg0": "." * child.level + ".".join(filter(None, [child.module, a.name])), "start": child.lineno} for a in child.names)
            elif isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name):
                rows.append({"row": "variable", "qual": here, "name": child.target.id, "arg0": tail(child.annotation).split("[")[0], "start": child.lineno})
            walk(child, scope, in_class and not isinstance(child, ast.Call))

    walk(tree, [], False)
    return [{"path": path, **r} for r in rows]


PARSED = "path string, row string, qual string, type string, start int, end int, name string, parent string, bases array<string>, decorators array<string>, receiver string, arg0 string"
#: Parsers by extension; register() adds to them.
PARSERS = {"py": python_rows, "pyi": python_rows}


def register(extension: str, parser) -> None:
    PARSERS[extension] = parser


def parse(files: DataFrame) -> DataFrame:
    """The rows of PARSED for each file whose extension has a parser: a Python function of one file, or, for languages with braces, DataFrame functions. files: path, text."""
    ship(files.sparkSession)
    names, parsers = [x.split()[0] for x in PARSED.split(", ")], dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["text"], strict=True) if (f := parsers.get(p.rpartition(".")[2].lower())) for r in f(p, t or "")]
            yield pd.DataFrame([{**dict.fromkeys(names), **r} for r in rows], columns=names)

    braced = files.where(~F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*parsers))
    return files.select("path", "text").mapInPandas(run, PARSED).unionByName(braces.parse(braced))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace records; lines that are none are left out."""
    rows = spark.read.schema(TRACE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    return rows.where("bad IS NULL AND t IS NOT NULL").drop("bad")
