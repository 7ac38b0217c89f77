"""Signals beside a node's content: fields and files that share state, what a project calls and declares, the ranking of all of them together, and how well a choice of them recalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The weights of signals and what each further one adds, how many functions a field may couple, how many files a type, how many patterns count.
SIGNAL_WEIGHTS = {"resource": 0.9, "state": 0.8, "field": 0.7, "import": 0.35}
COCHANGE_WEIGHT, CONSENSUS = 0.6, 0.25
MOST_SITES, MOST_FILES, FILE_SHARE = 12, 15, 0.5
MOST_PATTERNS, MOST_DECORATORS = 140, 30


def first_seen(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each group."""
    return most_of_each(df, by, order, 1)


def most_of_each(df: DataFrame, by: list[str], order: list[str | Column], most: int) -> DataFrame:
    """At most so many rows of each group, the first in the order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def change_counts(touches: DataFrame) -> DataFrame:
    """file, changes, fixes. touches: file, is_fix, a row for each commit and file."""
    return touches.groupBy("file").agg(F.count("*").alias("changes"), F.count_if("is_fix").alias("fixes"))


def field_sides(fields: DataFrame, hub: int | None = MOST_SITES) -> DataFrame:
    """key, fn, writer: fields that some functions write and others read; one that writes a field isn't its reader. hub: fields of more functions than this couple nothing. fields: key, fn, writer."""
    once = fields.groupBy("key", "fn").agg(F.max("writer").alias("writer"))
    per_key = once.groupBy("key").agg(F.count("*").alias("n"), F.count_if("writer").alias("w"))
    usable = (F.col("w") > 0) & (F.col("w") < F.col("n"))
    return once.join(per_key.where(usable & (F.col("n") <= hub) if hub else usable).select("key"), "key", "left_semi")


def field_partners(fields: DataFrame, seeds: DataFrame, hub: int | None = MOST_SITES) -> DataFrame:
    """fn: who reads fields that seeds (fn) write, or writes fields that they read. Meets the seeds' keys only; makes no pairs."""
    sides = field_sides(fields, hub)
    asked = sides.join(seeds.select("fn").distinct(), "fn", "left_semi").select("key", (~F.col("writer")).alias("writer")).distinct()
    return sides.join(asked, ["key", "writer"], "left_semi").join(seeds.select("fn"), "fn", "left_anti").select("fn").distinct()


def file_resources(access: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """rid, file, writes, reads: resources that at least so many files touch. access: fn, rid, kind; nodes: id, file."""
    writes = F.col("kind").isin("writes", "enqueues")
    per_file = access.join(nodes.select(F.col("id").alias("fn"), "file"), "fn").groupBy("rid", "file").agg(F.bool_or(writes).alias("writes"), F.bool_or(~writes).alias("reads"))
    return per_file.join(per_file.groupBy("rid").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("rid"), "rid", "left_semi")


def shared_counts(file_access: DataFrame, file: str) -> DataFrame:
    """file, n: how many resources each other file shares with this one."""
    mine = file_access.where(F.col("file") == file).select("rid")
    return file_access.where(F.col("file") != file).join(mine, "rid", "left_semi").groupBy("file").agg(F.countDistinct("rid").alias("n"))


def type_resources(references: DataFrame, producers: DataFrame, n_files: int, share: float = FILE_SHARE, most: int | None = MOST_FILES) -> DataFrame:
    """rid, file, writes, reads: types as resources, written where they are made and read where they are only mentioned. Types in one file, in more than the share of all, or in more than
    `most` say nothing. Both frames: type, file."""
    both = references.select("type", "file", F.lit(False).alias("made")).unionByName(producers.select("type", "file", F.lit(True).alias("made")))
    once = both.where("file IS NOT NULL").groupBy("type", "file").agg(F.max("made").alias("writes"))
    n = F.col("__n")
    fits = n.between(2, F.floor(F.lit(share * max(n_files, 1)))) & (n <= (most if most else n_files))
    kept = once.groupBy("type").agg(F.count("*").alias("__n")).where(fits).select("type")
    return once.join(kept, "type", "left_semi").select(F.concat(F.lit("type:"), "type").alias("rid"), "file", "writes", (~F.col("writes")).alias("reads"))


def ranked_union(content: DataFrame, legs: dict[str, DataFrame], cochange: DataFrame, seeds: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """id, score, pooled: every content node's scaled score, raised by each signal that names it and once more where several do; pooled says whether any does or it is a seed.
    content: id, score; legs: signal -> id; cochange: id, n."""
    weights = weights or SIGNAL_WEIGHTS
    flags = None
    for name, leg in legs.items():
        leg = leg.select("id").distinct().select("id", F.lit(weights[name]).alias("w"), F.lit(1).alias("signals"))
        flags = leg if flags is None else flags.unionByName(leg)
    top = cochange.agg(F.max("n").alias("__top"))
    moved = cochange.join(F.broadcast(top)).select("id", (COCHANGE_WEIGHT * F.col("n") / F.col("__top")).alias("w"), F.lit(1).alias("signals"))  # one row
    flags = moved if flags is None else flags.unionByName(moved)
    raised = flags.groupBy("id").agg(F.sum("w").alias("w"), F.sum("signals").alias("signals"))
    ends = content.agg(F.min("score").alias("__low"), F.max("score").alias("__high"))
    scaled = F.when(F.col("__high") > F.col("__low"), (F.col("score") - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.0)
    df = content.join(F.broadcast(ends)).join(raised, "id", "left").join(seeds.select("id").distinct().withColumn("__seed", F.lit(True)), "id", "left")  # ends is one row
    many = CONSENSUS * F.greatest(F.lit(0), F.coalesce("signals", F.lit(0)) - 1)
    return df.select("id", (scaled + F.coalesce("w", F.lit(0.0)) + many).alias("score"), (F.col("signals").isNotNull() | F.col("__seed").isNotNull()).alias("pooled"))


def call_patterns(sites: DataFrame, most: int = MOST_PATTERNS) -> DataFrame:
    """pattern, n: receivers' last names and methods, the commonest first. sites: receiver, method."""
    base = F.substring_index(F.element_at(F.split(F.coalesce("receiver", F.lit("")), r"\."), -1), "(", 1)
    pattern = F.when(base != "", F.concat_ws(".", base, "method")).otherwise(F.col("method"))
    return sites.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(most)


def decorator_patterns(symbols: DataFrame, most: int = MOST_DECORATORS) -> DataFrame:
    named = symbols.select(F.explode("decorators").alias("d")).select(F.substring_index("d", "(", 1).alias("decorator"))
    return named.groupBy("decorator").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "decorator").limit(most)


def sibling_dependencies(declared: DataFrame, modules: DataFrame) -> DataFrame:
    """module, sibling: modules of the same tree that a module declares as dependencies. declared: module, ecosystem, name; modules: module, ecosystem, name."""
    def named(df: DataFrame, keys: str) -> DataFrame:
        each = df.where("ecosystem IS NOT NULL AND name IS NOT NULL").groupBy("module").agg(F.collect_set(F.struct("ecosystem", "name")).alias(keys))  # of one module
        return each.select("module", keys, F.explode(keys).alias("k")).select("module", keys, "k.*")

    met = named(declared, "own").join(named(modules.select("module", "ecosystem", "name"), "known").withColumnRenamed("module", "sibling"), ["ecosystem", "name"]).where("module <> sibling")
    # A pair that meets by several names counts at the least of them, so that the pairs need not be brought together.
    once = (F.size("own") == 1) | (F.size("known") == 1) | (F.array_min(F.array_intersect("own", "known")) == F.struct("ecosystem", "name"))
    return met.where(once).select("module", "sibling")


def package_prefixes(files: DataFrame, most: int = 2000) -> DataFrame:
    """prefix: the first two parts of the packages that Java files name in their first characters. files: path, text."""
    package = F.regexp_extract(F.substring("text", 1, most), r"(?m)^[ \t]*package[ \t]+([\w.]+)[ \t]*;", 1)
    named = files.where(F.col("path").endswith(".java")).select(package.alias("p")).where("p <> ''")
    return named.select(F.array_join(F.slice(F.split("p", r"\."), 1, 2), ".").alias("prefix")).distinct()


def config_rows(definitions: DataFrame, reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """norm_key, file, line, value, more: keys that some of the nodes (id) read and some file defines, with the first definition and how many others there are. definitions: norm_key, file, line, value; reads: norm_key, reader."""
    asked = reads.join(nodes.select(F.col("id").alias("reader")), "reader", "left_semi").select("norm_key").distinct()
    first = definitions.join(asked, "norm_key", "left_semi").groupBy("norm_key").agg(F.min(F.struct("file", "line", "value")).alias("d"), (F.count("*") - 1).alias("more"))
    return first.select("norm_key", "d.file", "d.line", "d.value", "more")


def cochange_gold(pairs: DataFrame, least: int = 2, partners: int = 2) -> DataFrame:
    """query, id: for each file with enough of them, the files that changed with it often enough; what couplings are held against. pairs: a, b, n in both directions."""
    often = pairs.where(F.col("n") >= least)
    enough = often.groupBy("a").agg(F.count("*").alias("__n")).where(F.col("__n") >= partners).select("a")
    return often.join(enough, "a", "left_semi").select(F.col("a").alias("query"), F.col("b").alias("id"))


def recall_by_configuration(found: DataFrame, gold: DataFrame) -> DataFrame:
    """config, macro, micro, size: the mean recall over queries, that over all gold ids, and the mean number of ids found. A query for which a configuration finds nothing counts as 0. found: config, query, id; gold: query, id."""
    g, f = gold.select("query", "id").distinct(), found.select("config", "query", "id").distinct()
    wanted = g.groupBy("query").agg(F.count("*").alias("gold"))
    sizes = f.groupBy("config", "query").agg(F.count("*").alias("size"))
    hits = f.join(g, ["query", "id"], "left_semi").groupBy("config", "query").agg(F.count("*").alias("hits"))
    every = f.select("config").distinct().join(F.broadcast(wanted.agg(F.count("*").alias("queries"), F.sum("gold").alias("all"))))  # one row
    per_query = sizes.join(hits, ["config", "query"], "left").join(wanted, "query").groupBy("config")
    per_query = per_query.agg(F.sum(F.coalesce("hits", F.lit(0)) / F.col("gold")).alias("r"), F.sum(F.coalesce("hits", F.lit(0))).alias("h"), F.sum("size").alias("s"))
    out = lambda c, n: F.coalesce(F.col(c), F.lit(0)) / F.col(n)
    return every.join(per_query, "config", "left").select("config", out("r", "queries").alias("macro"), out("h", "all").alias("micro"), out("s", "queries").alias("size"))
