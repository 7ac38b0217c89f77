"""Candidates from many signals, with their provenance; and what there is to know about one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET = 120
SIGNALS = ("content", "resource", "state", "import-1hop", "co-change", "config-anchor", "package-sibling")


def tagged(legs: dict[str, DataFrame]) -> DataFrame:
    """id, tags: every candidate once, its tags in the order of the signals. legs: signal -> frame with id, and with rank where the order matters."""
    rows = None
    for prio, (tag, leg) in enumerate(legs.items()):
        label = F.concat(F.lit(f"{tag}#"), F.col("rank").cast("string")) if "rank" in leg.columns else F.lit(tag)
        leg = leg.select("id", F.lit(prio).alias("prio"), label.alias("tag")).distinct()
        rows = leg if rows is None else rows.unionByName(leg)
    return rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("prio", "tag"))), lambda x: x["tag"]).alias("tags"))


def pool(legs: dict[str, DataFrame], scores: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The candidates with most tags, then the best score, then the smaller id."""
    return tagged(legs).join(scores, "id", "left").withColumn("n_tags", F.size("tags")).orderBy(F.desc("n_tags"), F.desc_nulls_last("score"), "id").limit(budget)


def focused_siblings(nodes: DataFrame, chosen: DataFrame, least: int = 80) -> DataFrame:
    """id: nodes in the folders of chosen ones, where the folder has no more nodes than max(least, a 150th of all). nodes: id, dir."""
    n = nodes.count()
    counted = nodes.withColumn("__n", F.count("*").over(Window.partitionBy("dir"))).where(F.col("__n") <= max(least, n // 150))
    dirs = nodes.join(chosen.select("id"), "id", "left_semi").select("dir").distinct()
    return counted.join(dirs, "dir", "left_semi").join(chosen.select("id"), "id", "left_anti").select("id")


def impact(legs: list[tuple[str, DataFrame]], target: DataFrame, most: int = 40) -> DataFrame:
    """id, relation, n: each related node under the first relation that adds it, without the target; n counts them before the limit."""
    rows = None
    for prio, (name, leg) in enumerate(legs):
        leg = leg.select("id", F.lit(prio).alias("prio"), F.lit(name).alias("relation"))
        rows = leg if rows is None else rows.unionByName(leg)
    first = rows.join(target.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("prio", "relation")).alias("r"))
    total = first.agg(F.count("*").alias("n"))
    return first.join(F.broadcast(total)).select("id", "r.prio", "r.relation", "n").orderBy("prio", "id").limit(most)  # total is one row


def sections(legs: dict[str, DataFrame]) -> DataFrame:
    """section, item, n: reports of several parts as one long table; each leg has item and n."""
    rows = None
    for name, leg in legs.items():
        leg = leg.select(F.lit(name).alias("section"), F.col("item").cast("string").alias("item"), F.col("n").cast("long").alias("n"))
        rows = leg if rows is None else rows.unionByName(leg)
    return rows
