"""What was seen at run time: merging, resolving, freshness and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.functions import text as fn

SAMPLES, MUTATIONS = 8, 1000


def merge(prior: DataFrame, new: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Counts by entity and environment, added up over runs."""
    return prior.unionByName(new).groupBy(*keys).agg(F.sum(count).alias(count))


def merge_once(prior: DataFrame, new: DataFrame, keys: list[str], run: str = "run_id") -> DataFrame:
    """The same with each run's rows kept apart, so that a run that comes again replaces itself."""
    return prior.join(new.select(run).distinct(), run, "left_anti").unionByName(new.groupBy(run, *keys).agg(F.sum("n").alias("n")))


def top_samples(values: DataFrame, anchor: str = "anchor", value: str = "v", n: str = "n", most: int = SAMPLES) -> DataFrame:
    """The most frequent values of each anchor; ties to the smaller value."""
    w = Window.partitionBy(anchor).orderBy(F.desc(n), value)
    return values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def resolve_names(traced: DataFrame, nodes: DataFrame) -> DataFrame:
    """qual, id: the node whose name is the longest dotted suffix of a run-time name that is some node's alone; else the smallest id of the longest
    suffix that several share. traced: qual; nodes: id, qual."""
    suffixes = traced.select("qual").distinct().select("qual", F.posexplode(fn.name_suffixes(F.col("qual"))).alias("pos", "suffix"))
    named = nodes.groupBy(F.col("qual").alias("suffix")).agg(F.min("id").alias("id"), F.count("*").alias("shared"))
    best = F.min_by("id", F.struct((F.col("shared") > 1).alias("a"), F.col("pos").alias("p")))
    return suffixes.join(named, "suffix").groupBy("qual").agg(best.alias("id"))


def unresolved(traced: DataFrame, resolved: DataFrame, most: int = 8) -> DataFrame:
    """cls, n: the prefixes of names that no node answers to, and how many."""
    left = traced.select("qual").distinct().join(resolved, "qual", "left_anti")
    return left.groupBy(F.regexp_extract("qual", r"^(.*)\.[^.]*$", 1).alias("cls")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cls").limit(most)


def freshness(stored: DataFrame, current: DataFrame, key: str, hash_: str = "hash") -> DataFrame:
    """stored with status: fresh where the hash is the current one, stale where it differs, gone where the key is no more."""
    now = current.select(key, F.col(hash_).alias("__now"), F.lit(True).alias("__there"))
    return stored.join(now, key, "left").withColumn("status", F.when(F.col("__there").isNull(), "gone").when(F.col(hash_) == F.col("__now"), "fresh").otherwise("stale")).drop("__now", "__there")


def confirmed_edges(edges: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Edges (caller, callee) of which both ends are confirmed (id)."""
    ids = confirmed.select("id").distinct()
    return edges.join(ids, edges["caller"] == ids["id"], "left_semi").join(ids, F.col("callee") == ids["id"], "left_semi")


def kept_mutations(mutations: DataFrame, confirmed: DataFrame, most: int = MUTATIONS) -> DataFrame:
    """Mutations without anchor, or of a confirmed one; the most frequent."""
    ids = confirmed.select(F.col("id").alias("anchor"), F.lit(True).alias("__ok")).distinct()
    return mutations.join(ids, "anchor", "left").where("anchor IS NULL OR __ok").drop("__ok").orderBy(F.desc("n"), "anchor", "target").limit(most)


def coverage(targets: DataFrame, executed: DataFrame, instrumented: DataFrame, traced: bool) -> DataFrame:
    """id, cls, status: executed, else instrumented (its class was, by name or dotted suffix), else not-instrumented; no-trace if nothing was traced."""
    if not traced:
        return targets.withColumn("status", F.lit("no-trace"))
    ran = executed.select("id").distinct().withColumn("__ran", F.lit(True))
    seen = instrumented.select(F.explode(fn.name_suffixes(F.col("name"))).alias("cls")).distinct().withColumn("__seen", F.lit(True))
    return targets.join(ran, "id", "left").join(seen, "cls", "left").withColumn("status", F.when(F.col("__ran"), "executed").when(F.col("__seen"), "instrumented").otherwise("not-instrumented")).drop("__ran", "__seen")


def observed_config(samples: DataFrame, keys: DataFrame) -> DataFrame:
    """norm_key, value, n: what calls returned that named a known key. samples: v (`(args) => value`), n; keys: norm_key."""
    parted = samples.select("n", F.split("v", " => ", 2).alias("p")).where(F.size("p") == 2)
    named = parted.select("n", F.explode(F.regexp_extract_all(F.col("p")[0], F.lit('"([^"]*)"'), F.lit(1))).alias("k"), F.regexp_replace(F.col("p")[1], '^"|"$', "").alias("value"))
    return named.withColumn("norm_key", fn.config_key(F.col("k"))).join(keys.select("norm_key").distinct(), "norm_key", "left_semi").groupBy("norm_key", "value").agg(F.sum("n").alias("n"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, deleted or changed, by modification time and size. Both: path, mtime, size."""
    a = after.select("path", F.col("mtime").alias("m2"), F.col("size").alias("s2"), F.lit(1).alias("in2"))
    both = before.withColumn("in1", F.lit(1)).join(a, "path", "full_outer")
    change = F.when(F.col("in1").isNull(), "added").when(F.col("in2").isNull(), "deleted").when((F.col("mtime") != F.col("m2")) | (F.col("size") != F.col("s2")), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")
