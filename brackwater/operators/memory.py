"""Remembered facts: anchors of citations, insertion, status, recall, and the store that keeps them between sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.functions import text as fn
from brackwater.store import BucketStore, bucket_of

LEAST_LIKENESS, RECALLED = 0.35, 6


def anchored(facts: DataFrame, citations: DataFrame) -> DataFrame:
    """Facts that cite something; the others are dropped. citations: fact_id, anchor, hash."""
    return facts.join(citations.select("fact_id").distinct(), "fact_id", "left_semi")


def supersede(facts: DataFrame, citations: DataFrame) -> DataFrame:
    """Facts without those that a later fact of the same kind, sharing any anchor, replaces. facts: fact_id, kind, ts; ties in ts go by fact_id."""
    c = citations.join(facts.select("fact_id", "kind", "ts"), "fact_id").select("fact_id", "kind", "ts", "anchor").distinct()
    latest = c.groupBy("anchor", "kind").agg(F.max(F.struct("ts", "fact_id")).alias("last"))
    gone = c.join(latest, ["anchor", "kind"]).where(F.struct("ts", "fact_id") < F.col("last")).select("fact_id").distinct()
    return anchored(facts, citations).join(gone, "fact_id", "left_anti")


def status(citations: DataFrame) -> DataFrame:
    """fact_id, status: gone if all that a fact cites is gone, stale if any of it is stale or gone, else active. citations: fact_id, state."""
    return citations.groupBy("fact_id").agg(F.when(F.bool_and(F.col("state") == "gone"), "gone").when(F.bool_or(F.col("state") != "fresh"), "stale").otherwise("active").alias("status"))


def recall(facts: DataFrame, citations: DataFrame, statuses: DataFrame, anchors: DataFrame, files: DataFrame, likeness: DataFrame | None = None, kind: str | None = None, most: int = RECALLED) -> DataFrame:
    """The newest facts that are not gone and cite one of the anchors or files; if there are none, those most like the query. likeness: fact_id, score."""
    live = facts.join(statuses, "fact_id").where("status <> 'gone'")
    if kind:
        live = live.where(F.col("kind") == kind)
    hit = citations.join(anchors.select("anchor").distinct(), "anchor", "left_semi").select("fact_id").union(citations.join(files.select("file").distinct(), "file", "left_semi").select("fact_id")).distinct()
    found = live.join(hit, "fact_id", "left_semi").withColumn("score", F.lit(None).cast("double"))
    if likeness is not None:
        none = found.agg((F.count("*") == 0).alias("__none"))
        close = live.join(likeness.where(F.col("score") > LEAST_LIKENESS), "fact_id").join(F.broadcast(none)).where("__none").drop("__none")  # one row
        found = found.unionByName(close.select(found.columns))
    return found.orderBy(F.desc_nulls_last("score"), F.desc("ts"), "fact_id").limit(most)


# Kinds of facts; one without a kind, or with another, is a mechanism.
KINDS = ("mechanism", "expectation", "observation")
FACTS = "fact_id string, kind string, text string, ts long"
CITATIONS = "fact_id string, citation string, anchor string, file string, hash string"


def kind_of(kind: str = "kind") -> Column:
    return F.when(F.col(kind).isin(*KINDS), F.col(kind)).otherwise(KINDS[0])


def anchors_of(citations: DataFrame, symbols: DataFrame, keys: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """citations (fact_id, citation) with anchor, file and hash: what each one means now, from the first of these that finds anything: a node's id; file:line (the smallest symbol around it); a qualified name; the end of one, after a
    dot; a bare name; a configuration key. Those that mean nothing go. symbols: id, file, qual, name, start, end; keys: norm_key, file, line, value (definitions); files: path, text, for the hashes of symbols' lines."""
    c = citations.select("fact_id", "citation").distinct()
    s = symbols.select("id", "file", "qual", "name", "start", "end")
    size = F.col("end") - F.col("start")
    at = c.where(F.col("citation").rlike(r":\d+$")).select("*", F.regexp_extract("citation", r"^(.*):\d+$", 1).alias("file"), F.regexp_extract("citation", r":(\d+)$", 1).cast("int").alias("line"))
    ends = s.select("id", "file", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("qual", r"\."))), lambda n: F.array_join(F.slice(F.split("qual", r"\."), n, 99), "."))).alias("citation"), "qual")
    legs = [
        c.join(s.select(F.col("id").alias("citation"), "id", "file", size.alias("size")), "citation"),
        at.join(s.where("qual <> '<module>'"), "file").where("line BETWEEN start AND end").select("citation", "fact_id", "id", "file", size.alias("size")),
        c.join(ends.where("citation = qual").drop("qual"), "citation"),
        c.join(ends.where("citation <> qual").drop("qual"), "citation"),
        c.join(s.select(F.col("name").alias("citation"), "id", "file", size.alias("size")), "citation"),
    ]
    rows = None
    for tier, leg in enumerate(legs):
        leg = leg.select("fact_id", "citation", F.lit(tier).alias("tier"), "size", "id", "file")
        rows = leg if rows is None else rows.unionByName(leg)
    config = keys.groupBy("norm_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "value"))), lambda d: F.concat(d["file"], F.lit(":"), d["line"].cast("string"), F.lit("="), d["value"].cast("string"))), "|").alias("defs"))  # of one key
    asked = c.withColumn("norm_key", fn.config_key(F.col("citation")))
    found = rows.unionByName(asked.join(config.select("norm_key"), "norm_key").select("fact_id", "citation", F.lit(len(legs)).alias("tier"), F.lit(0).alias("size"), F.concat(F.lit("config::"), "norm_key").alias("id"), F.lit(None).cast("string").alias("file")))
    best = found.groupBy("fact_id", "citation").agg(F.min(F.struct("tier", "size", "id", "file")).alias("b")).select("fact_id", "citation", F.col("b.id").alias("anchor"), F.col("b.file").alias("file"))
    hashes = config.select(F.concat(F.lit("config::"), "norm_key").alias("anchor"), fn.span_hash(F.col("defs")).alias("hash"))
    if files is not None:
        spans = s.join(files.select(F.col("path").alias("file"), "text"), "file").select(F.col("id").alias("anchor"), fn.span_hash(fn.span_text(F.col("text"), F.col("start"), F.col("end"))).alias("hash"))
        hashes = hashes.unionByName(spans)
    return best.join(hashes, "anchor", "left").select("fact_id", "citation", "anchor", "file", "hash")


def states(citations: DataFrame, now: DataFrame) -> DataFrame:
    """fact_id, state of each stored citation: fresh, stale (its anchor's hash differs) or gone. now: anchor, hash, as they are."""
    known = now.select("anchor", F.col("hash").alias("now"), F.lit(True).alias("there")).distinct()
    state = F.when(F.col("there").isNull(), "gone").when(F.col("now").eqNullSafe(F.col("hash")), "fresh").otherwise("stale")
    return citations.join(known, "anchor", "left").select("fact_id", "anchor", state.alias("state"))


class Memory:
    """Facts that outlive a session: two tables of a BucketStore in buckets of facts' ids. Each insertion is a whole new state, so a reader in another session never sees half of one."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.store, self.buckets = spark, BucketStore(spark, root), buckets

    def facts(self) -> DataFrame:
        return self.store.read("facts", FACTS).drop("bucket")

    def citations(self) -> DataFrame:
        return self.store.read("citations", CITATIONS).drop("bucket")

    def remember(self, facts: DataFrame, citations: DataFrame) -> dict[str, int]:
        """Adds facts (fact_id, kind, text, ts) that cite something (anchors_of()), and drops those that later ones of their kind replace, by any anchor that both cite. How many came and went."""
        new = facts.select(F.col("fact_id").cast("string").alias("fact_id"), kind_of().alias("kind"), "text", F.col("ts").cast("long").alias("ts"))
        cited = citations.select(*[F.col(c.split()[0]).cast("string").alias(c.split()[0]) for c in CITATIONS.split(", ")])
        # A fact that is told again takes its own place.
        told = new.select("fact_id").distinct()
        old_facts, old_cited = self.facts().join(told, "fact_id", "left_anti"), self.citations().join(told, "fact_id", "left_anti")
        once = new.withColumn("__r", F.row_number().over(Window.partitionBy("fact_id").orderBy(F.desc("ts"), "text"))).where("__r = 1").drop("__r")
        all_facts, all_cited = old_facts.unionByName(once), old_cited.unionByName(cited).distinct()
        kept = supersede(all_facts, all_cited)
        placed = lambda df: df.withColumn("bucket", bucket_of(F.col("fact_id"), self.buckets))
        before = self.facts().count()
        self.store.commit({"facts": (placed(kept), range(self.buckets)), "citations": (placed(all_cited.join(kept.select("fact_id"), "fact_id", "left_semi")), range(self.buckets))}, sort={"facts": ["fact_id"], "citations": ["fact_id"]})
        self.store.vacuum()
        after, came = self.facts(), told.count()
        stayed = after.join(told, "fact_id", "left_semi").count()
        return {"remembered": stayed, "dropped": came - stayed, "replaced": before + stayed - after.count()}

    def recall(self, now: DataFrame, anchors: DataFrame, files: DataFrame, kind: str | None = None, likeness: DataFrame | None = None, most: int = RECALLED) -> DataFrame:
        """recall() of what is stored, with each fact's status as its anchors are now (anchor, hash)."""
        cited = self.citations()
        return recall(self.facts(), cited, status(states(cited, now)), anchors, files, likeness, kind, most)
