"""A program's symbols as tables: what contains, inherits, calls and imports what, which symbol a text means, and what a change of it reaches.

symbols: file, qual, type, start, end, name, parent, bases, decorators, as sources.files.parse() gives them (row = 'symbol'). A node's id is its file and its
qualified name, joined by two colons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.operators.graph import page_rank
from brackwater.operators.pool import impact as first_relations
from brackwater.operators.retrieval import best_files
from brackwater.storage import cut

MODULE = "<module>"
CONTENT_TYPES = ("function", "method", "class")
#: What an import of a script may leave out of a path.
SCRIPT_ENDS = ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts", "/index.jsx", "/index.tsx")
IMPACT_ORDER = ("runtime-caller", "runtime-callee", "downstream", "upstream", "co-writer", "sibling", "caller?")
MOST_TARGETS, MOST_CALLERS = 8, 20


def node_id(file: Column, qual: Column) -> Column:
    return F.concat(file, F.lit("::"), qual)


def nodes(parsed: DataFrame) -> DataFrame:
    """id and the columns of each symbol, the first of each id by its start."""
    s = parsed.where("row = 'symbol'").select(node_id(F.col("path"), F.col("qual")).alias("id"), F.col("path").alias("file"), "qual", "type", "start", "end", "name", "parent", "bases", "decorators")
    w = Window.partitionBy("id").orderBy("start", "end")
    return s.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def content_nodes(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("type").isin(*CONTENT_TYPES))


def with_fallback(rows: DataFrame, symbols: DataFrame, file: str, qual: str, out: str) -> DataFrame:
    """rows with `out`: the node of (file, qual), or else the file's module; rows that have neither go."""
    ids = symbols.select(F.col("id").alias("__id"))
    own, module = node_id(F.col(file), F.col(qual)), node_id(F.col(file), F.lit(MODULE))
    found = rows.join(ids, own == F.col("__id"), "left").withColumnRenamed("__id", "__own")
    found = found.join(ids, module == F.col("__id"), "left").withColumn(out, F.coalesce("__own", "__id"))
    return found.drop("__own", "__id").where(F.col(out).isNotNull())


def contains(symbols: DataFrame) -> DataFrame:
    """parent, child: each symbol but modules, in what holds it or else in its module."""
    inner = symbols.where(F.col("type") != "module").select(F.col("id").alias("child"), "file", F.coalesce(F.nullif("parent", F.lit("")), F.lit(MODULE)).alias("holder"))
    return with_fallback(inner, symbols, "file", "holder", "parent").where("parent <> child").select("parent", "child")


def inherits(symbols: DataFrame) -> DataFrame:
    """child, parent: each class and every class that bears the simple name of one of its bases."""
    classes = symbols.where("type = 'class'")
    bases = classes.select(F.col("id").alias("child"), F.explode(F.array_distinct("bases")).alias("name"))
    return bases.join(classes.select("name", F.col("id").alias("parent")), "name").where("child <> parent").select("child", "parent").distinct()


def call_sites(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
    """fn_id, file, receiver, method, arg0, type: calls with the function they stand in (or its module) and the declared type of their receiver in that file, the first one that a variable has."""
    calls = parsed.where("row = 'call'").select(F.col("path").alias("file"), "qual", "receiver", F.col("name").alias("method"), "arg0")
    types = parsed.where("row = 'variable'").groupBy(F.col("path").alias("__file"), F.col("name").alias("__var")).agg(F.min_by("arg0", "start").alias("type"))
    last = F.substring_index(F.element_at(F.split(F.coalesce("receiver", F.lit("")), r"\."), -1), "(", 1)
    typed = with_fallback(calls, symbols, "file", "qual", "fn_id").withColumn("__last", last)
    return typed.join(types, (F.col("file") == F.col("__file")) & (F.col("__last") == F.col("__var")), "left").select("fn_id", "file", "receiver", "method", "arg0", "type")


def folded(path: Column) -> Column:
    """A path whose `.` and `..` are resolved."""
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_edges(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: which file imports which, for Python (dotted, relative), scripts (relative) and Java (types, their members, whole packages). parsed: rows of imports, where arg0 is what is imported; files: path, and text for Java.
    A dotted name opens into its prefixes, the longest that is a file of the tree wins; what isn't found from the tree's root is the one file whose path ends so, if only one does."""
    imports = parsed.where("row = 'import'").select(F.col("path").alias("src"), F.col("arg0").alias("what"), F.monotonically_increasing_id().alias("no"))
    imports = cut(imports, "imports")
    parts = F.split("src", "/")
    folder = lambda up: F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - up))
    dots = F.length(F.regexp_extract("what", r"^(\.*)", 1))
    script, java = F.col("src").rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)$"), F.col("src").endswith(".java")
    named = F.filter(F.split(F.ltrim("what", F.lit(".")), r"\."), lambda x: x != "")
    base = F.when(dots > 0, F.concat(folder(F.greatest(dots, F.lit(1))), named)).otherwise(named)
    prefixes = lambda of, end: F.transform(F.sequence(F.size(of), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(of, F.lit(1), n), end))
    python = F.flatten(F.transform(prefixes(base, "/"), lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))))
    beside = folded(F.concat_ws("/", F.array_join(folder(F.lit(1)), "/"), "what"))
    plain = F.transform(F.array(*map(F.lit, SCRIPT_ENDS)), lambda e: F.concat(beside, e))
    paths = files.select(F.col("path").alias("dst")).distinct()
    tried = imports.where(~java & F.when(script, F.col("what").startswith(".")).otherwise(F.size(base) > 0)).select("no", "src", "what", F.posexplode(F.when(script, plain).otherwise(python)).alias("place", "dst"))
    first = lambda df: df.groupBy("no", "src").agg(F.min_by("dst", "place").alias("dst"))
    known = cut(first(tried.join(paths, "dst")), "known")
    # Absolute Python names below a folder that is not the tree's root: paths open into their suffixes, of which those count that one file has.
    modules = paths.where(F.col("dst").rlike(r"\.pyi?$")).select("dst", F.split(F.regexp_replace("dst", r"(/__init__)?\.pyi?$", ""), "/").alias("p"))
    suffixes = modules.select("dst", F.explode(F.transform(F.sequence(F.lit(2), F.size("p")), lambda n: F.array_join(F.slice("p", n, 99), "."))).alias("name"))
    only = suffixes.where(F.col("name") != "").groupBy("name").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1").select("name", "dst")
    lost = imports.where(~script & ~java & ~F.col("what").startswith(".")).join(known.select("no"), "no", "left_anti")
    below = first(lost.select("no", "src", F.posexplode(prefixes(named, ".")).alias("place", "name")).join(only, "name"))
    edges = known.unionByName(below)
    if "text" in files.columns:
        package = F.regexp_extract("text", r"(?m)^[ \t]*package[ \t]+([\w.]+)[ \t]*;", 1)
        types = files.where(F.col("path").endswith(".java")).select(F.col("path").alias("dst"), package.alias("package"), F.regexp_extract("path", r"([^/]+)\.java$", 1).alias("type"))
        types = cut(types.select("dst", "package", F.concat_ws(".", F.nullif("package", F.lit("")), "type").alias("name")), "types")
        asked = imports.where(java)
        whole = asked.where(F.col("what").endswith(".*")).select("no", "src", F.regexp_replace("what", r"\.\*$", "").alias("package")).join(types, "package").select("no", "src", "dst")
        single = first(asked.where(~F.col("what").endswith(".*")).select("no", "src", F.posexplode(prefixes(F.split("what", r"\."), ".")).alias("place", "name")).join(types.groupBy("name").agg(F.min("dst").alias("dst")), "name"))
        edges = edges.unionByName(whole).unionByName(single)
    return edges.where("src <> dst").select("src", "dst").distinct()


def resolve(symbols: DataFrame, target: str, most: int = MOST_TARGETS) -> DataFrame:
    """id: what a text means: a node's id, or file:line (the smallest symbol there), or a qualified name, or the end of one after a dot, or a bare name; the first of these that finds anything."""
    t = target.strip()
    head, _, tail = t.rpartition(":")
    at_line = head and tail.isdigit() and "::" not in t
    legs = []
    if "::" in t:
        legs.append(symbols.where(F.col("id") == t))
    if at_line:
        here = symbols.where((F.col("file") == head.lstrip("./")) & (F.col("type") != "module") & (F.col("start") <= int(tail)) & (F.col("end") >= int(tail)))
        return here.orderBy(F.col("end") - F.col("start"), "id").limit(1).select("id")
    legs.append(symbols.where(F.col("qual") == t))
    legs.append(symbols.where(F.col("qual").endswith("." + t)).orderBy("id").limit(most))
    legs.append(symbols.where((F.col("name") == t) & (F.col("type") != "module")).orderBy("id").limit(most))
    rows = None
    for tier, leg in enumerate(legs):
        leg = leg.select("id", F.lit(tier).alias("tier"))
        rows = leg if rows is None else rows.unionByName(leg)
    return rows.withColumn("__best", F.min("tier").over(Window.partitionBy(F.lit(0)))).where("tier = __best").select("id").distinct()  # two tiers of `most` rows, and those of one name


def callers(sites: DataFrame, symbols: DataFrame, targets: DataFrame, most: int = MOST_CALLERS) -> DataFrame:
    """id, n: functions that call a method of a target's name, and how often; the most frequent first."""
    names = symbols.join(targets, "id", "left_semi").select(F.col("name").alias("method")).distinct()
    found = sites.join(F.broadcast(names), "method", "left_semi").groupBy(F.col("fn_id").alias("id")).agg(F.count("*").alias("n"))  # names of MOST_TARGETS symbols
    return found.join(targets, "id", "left_anti").orderBy(F.desc("n"), "id").limit(most)


def impact(symbols: DataFrame, sites: DataFrame, access: DataFrame, targets: DataFrame, runtime: DataFrame | None = None, most: int = 40) -> DataFrame:
    """id, prio, relation, n: what a change of the targets reaches, each node under the first relation that finds it: seen calling or called at run time (runtime: caller, callee), reading what they
    write, writing what they read, writing what they write, beside them in a class or module, calling their names. access: fn, rid, kind."""
    t = cut(targets.select("id").distinct(), "targets")
    side = access.select("rid", "fn", F.col("kind").isin("writes", "enqueues").alias("writer")).distinct()
    mine = side.join(t, F.col("fn") == F.col("id"), "left_semi").select("rid", F.col("writer").alias("own"))
    met = side.join(mine.distinct(), "rid")
    held = contains(symbols)
    siblings = held.join(held.join(t, F.col("child") == F.col("id"), "left_semi").select("parent").distinct(), "parent", "left_semi").select(F.col("child").alias("id"))
    none = t.limit(0)
    by_relation = {
        "runtime-caller": runtime.join(t, F.col("callee") == F.col("id"), "left_semi").select(F.col("caller").alias("id")) if runtime is not None else none,
        "runtime-callee": runtime.join(t, F.col("caller") == F.col("id"), "left_semi").select(F.col("callee").alias("id")) if runtime is not None else none,
        "downstream": met.where("own AND NOT writer").select(F.col("fn").alias("id")),
        "upstream": met.where("NOT own AND writer").select(F.col("fn").alias("id")),
        "co-writer": met.where("own AND writer").select(F.col("fn").alias("id")),
        "sibling": siblings,
        "caller?": callers(sites, symbols, t).select("id"),
    }
    known = symbols.where(F.col("type") != "module").select("id")
    return first_relations([(k, by_relation[k].join(known, "id", "left_semi")) for k in IMPACT_ORDER], t, most)


def file_lift(imports: DataFrame, content: DataFrame, file: str = "file", seeds: int = 15) -> DataFrame:
    """file, lift: PageRank over imports from the best content files, over the same from everywhere."""
    start = best_files(content, file, seeds)
    return page_rank(imports, start).select(F.col("id").alias(file), "lift")


def type_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("type").agg(F.count("*").alias("n"))


def dominant_language(symbols: DataFrame) -> str | None:
    """The extension that most nodes come from; ties to the smaller name."""
    ext = F.lower(F.element_at(F.split("file", r"\."), -1))
    found = symbols.groupBy(ext.alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").first()
    return found["ext"] if found else None


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of an index as Parquet below the path, in the place of an earlier one."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_index(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names}


def build_index(parsed: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """nodes, contains, inherits, calls and imports of a parsed tree."""
    symbols = cut(nodes(parsed), "nodes")
    return {"nodes": symbols, "contains": contains(symbols), "inherits": inherits(symbols), "calls": call_sites(parsed, symbols), "imports": import_edges(parsed, files)}


def ticket_file(commits: DataFrame, ticket: str) -> DataFrame:
    """file, n: the product file that commits of a ticket touch most; ties to the smaller name. commits: tickets, files."""
    from brackwater.functions.text import is_test_path

    touched = commits.where(F.array_contains("tickets", ticket.lstrip("#"))).select(F.explode(F.array_distinct("files")).alias("file"))
    return touched.where(~is_test_path(F.concat(F.lit("/"), F.col("file")))).groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(1)


def mutation_reach(mutations: DataFrame, focus: DataFrame, runtime: DataFrame) -> DataFrame:
    """target, writer, reader: keys that the focus (id), or what it called at run time (caller, callee), writes, and who reads them. mutations: anchor, target, op."""
    reach = focus.select("id").union(runtime.join(focus, F.col("caller") == F.col("id"), "left_semi").select("callee")).distinct()
    ops = mutations.select("anchor", "target", "op").distinct()
    written = ops.where("op = 'write'").join(reach, F.col("anchor") == F.col("id"), "left_semi").select("target", F.col("anchor").alias("writer"))
    return written.join(ops.where("op = 'read'").select("target", F.col("anchor").alias("reader")), "target").where("writer <> reader")
