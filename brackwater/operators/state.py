"""The types that hold a program's state: who mentions and makes them, which of them a task implies, and what belongs to them.

nodes: id, file, name, qual, type, text (of the symbol). A type is defined by each class that bears its name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.functions import text as fn
from brackwater.operators.graph import capped_uses

# Words by which a task points at caches and queues.
CACHE_WORDS = r"(?i)\b(cache|cached|caching|redis|ttl|evict|expire|expired|stale)\b"
QUEUE_WORDS = r"(?i)\b(queue|queued|kafka|rabbit|mq|message|consumer|producer|topic|event|async)\b"
MOST_CANDIDATES, MOST_FALLBACK = 400, 3


def definitions(nodes: DataFrame) -> DataFrame:
    """type, node: classes by their names."""
    return nodes.where("type = 'class'").select(F.col("name").alias("type"), F.col("id").alias("node"))


def references(nodes: DataFrame) -> DataFrame:
    """type, node: capitalised names in a node's text that some class bears, but for its own."""
    words = nodes.select(F.col("id").alias("node"), "name", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][A-Za-z0-9_]+"), F.lit(0)))).alias("type"))
    return words.where("type <> name").join(definitions(nodes).select("type").distinct(), "type", "left_semi").select("type", "node")


def producers(nodes: DataFrame) -> DataFrame:
    """type, node: who constructs (new T, T(...)), builds (T.builder(), T.of()) or returns (-> T, T name(...)) a type."""
    made = F.concat(
        F.regexp_extract_all("text", F.lit(r"\bnew\s+([A-Z]\w*)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?<![\w.])([A-Z]\w*)\s*\("), F.lit(1)),
        F.regexp_extract_all("text", F.lit(r"\b([A-Z]\w*)\.(?:builder|of|newBuilder)\("), F.lit(1)), F.regexp_extract_all("text", F.lit(r"->\s*[\"']?([A-Z]\w*)"), F.lit(1)),
        F.regexp_extract_all("text", F.lit(r"\b([A-Z]\w*)(?:<[^>]*>)?\s+\w+\s*\("), F.lit(1)),
    )
    found = nodes.select(F.col("id").alias("node"), "name", F.explode(F.array_distinct(made)).alias("type")).where("type <> name")
    return found.join(definitions(nodes).select("type").distinct(), "type", "left_semi").select("type", "node").distinct()


def lineage(types: DataFrame, nodes: DataFrame, inherits: DataFrame, contains: DataFrame, uses: DataFrame, made: DataFrame, touching: DataFrame) -> DataFrame:
    """id: definitions of the types (type), what they inherit from and what inherits from them, their members, and who mentions them; of types that more than 40 nodes mention, only
    who makes them, capped as capped_uses() does. touching: id of nodes that touch resources."""
    t = types.select("type").distinct()
    own = definitions(nodes).join(t, "type", "left_semi").select(F.col("node").alias("id"))
    up = inherits.join(own, F.col("child") == F.col("id"), "left_semi").select(F.col("parent").alias("id"))
    down = inherits.join(own, F.col("parent") == F.col("id"), "left_semi").select(F.col("child").alias("id"))
    members = contains.join(own, F.col("parent") == F.col("id"), "left_semi").select(F.col("child").alias("id"))
    counted = uses.join(t, "type", "left_semi").withColumn("refs", F.count("*").over(Window.partitionBy("type")))
    few = counted.where("refs <= 40").select(F.col("node").alias("id"))
    marked = made.join(t, "type", "left_semi").join(counted.where("refs > 40").select("type", "refs").distinct(), "type").join(touching.select(F.col("id").alias("node"), F.lit(True).alias("touches")).distinct(), "node", "left")
    place = F.row_number().over(Window.partitionBy("type", "touches").orderBy("node"))
    makers = marked.withColumn("touches", F.coalesce("touches", F.lit(False))).withColumn("place", place).where(F.col("touches") | (F.col("place") <= F.greatest(F.lit(25), F.floor(F.col("refs") / 4))))
    return own.union(up).union(down).union(members).union(few).union(makers.select(F.col("node").alias("id"))).distinct()


def candidates(nodes: DataFrame, seed_files: DataFrame | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """type, place: types that are no infrastructure, those that look like data first, services last, then by name. Of more than `most`, those defined in the seeds' files, if there are any."""
    defs = nodes.where("type = 'class'").select(F.col("name").alias("t"), "file").where(~F.col("t").rlike(fn.INFRA_TYPE) | F.col("t").rlike(fn.DATA_TYPE))
    kinds = defs.groupBy("t").agg(F.min(F.when(F.col("t").rlike(fn.DATA_TYPE) & ~F.col("t").rlike(fn.NON_DATA_TYPE), 0).when(F.col("t").rlike(fn.NON_DATA_TYPE), 2).otherwise(1)).alias("kind"))
    if seed_files is not None and kinds.limit(most + 1).count() > most:
        near = defs.join(seed_files.select("file").distinct(), "file", "left_semi").select("t").distinct()
        if near.limit(1).count():
            kinds = kinds.join(near, "t", "left_semi")
    return kinds.orderBy("kind", "t").limit(most).select(F.col("t").alias("type"), F.row_number().over(Window.orderBy("kind", "t")).alias("place"))  # `most` rows


def implied(nodes: DataFrame, uses: DataFrame, resources: DataFrame, task: str, names: list[str], tokens: list[str], seeds: DataFrame) -> DataFrame:
    """type: those that the task names, and the state of resources that it points at: by words for caches or queues, by a seed or its file, by a word of the function's name. If that is nothing,
    the data types that most seeds mention. resources: id, kind (cache, queue), types (array); seeds: id; names and tokens: of the task."""
    import re

    known = definitions(nodes).select("type").distinct()
    plain = ~F.col("type").rlike(fn.INFRA_TYPE) | F.col("type").rlike(fn.DATA_TYPE)
    named = known.where(F.col("type").isin(*names or [""]) & plain)
    kinds = [k for k, words in (("cache", CACHE_WORDS), ("queue", QUEUE_WORDS)) if re.search(words, task or "")]
    seeded = nodes.join(seeds.select("id"), "id", "left_semi")
    near = nodes.join(seeded.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("__near"))
    here = resources.join(nodes.select("id", "qual"), "id").join(near, F.col("id") == F.col("__near"), "left")
    pointed = here.where(F.col("kind").isin(*kinds or [""]) | F.col("__near").isNotNull() | F.arrays_overlap(fn.subtokens(F.col("qual")), F.array(*map(F.lit, tokens or [""]))))
    found = named.union(pointed.select(F.explode("types"))).distinct()
    data = uses.where(F.col("type").rlike(fn.DATA_TYPE) & plain).join(seeds.select(F.col("id").alias("node")), "node", "left_semi").groupBy("type").agg(F.countDistinct("node").alias("n"))
    fallback = data.orderBy(F.desc("n"), "type").limit(MOST_FALLBACK).select("type")
    none = found.agg((F.count("*") == 0).alias("__none"))
    return found.unionByName(fallback.join(F.broadcast(none)).where("__none").drop("__none"))  # one row


__all__ = ["candidates", "capped_uses", "definitions", "implied", "lineage", "producers", "references"]
