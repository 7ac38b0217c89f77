"""Measures of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.storage import cut

#: Lines of a file that a bin spans.
BIN_LINES = 64


def smallest_enclosing(points: DataFrame, spans: DataFrame, bin_lines: int = BIN_LINES) -> DataFrame:
    """file, line, id: the smallest span (file, id, start, end) that holds a point (file, line); ties to the smaller id. Points meet the spans of
    their bin of lines only; a span has a row in each bin that it reaches."""
    at = lambda c: F.floor(F.col(c) / bin_lines)
    binned = spans.where("start <= end").select("file", "id", "start", "end", F.explode(F.sequence(at("start"), at("end"))).alias("bin"))
    inside = points.withColumn("bin", at("line")).join(binned, ["file", "bin"]).where("line BETWEEN start AND end")
    size = F.struct((F.col("end") - F.col("start")).alias("a"), F.col("id").alias("b"))
    return inside.groupBy("file", "bin", "line").agg(F.min_by("id", size).alias("id")).drop("bin")  # a line has one bin, by which the rows are dealt already


def overlapping(targets: DataFrame, spans: DataFrame, bin_lines: int = BIN_LINES) -> DataFrame:
    """file, t_start, t_end, id, rank: spans that overlap each target, the smallest first. Targets and spans meet in the bins of lines that both reach; the first such bin of a pair counts."""
    at = lambda c: F.floor(F.col(c) / bin_lines)
    left = targets.select("file", F.col("start").alias("t_start"), F.col("end").alias("t_end")).where("t_start <= t_end").distinct()
    left = left.select("*", F.explode(F.sequence(at("t_start"), at("t_end"))).alias("bin"))
    right = spans.where("start <= end").select("file", "id", "start", "end", F.explode(F.sequence(at("start"), at("end"))).alias("bin"))
    both = left.join(right, ["file", "bin"]).where("start <= t_end AND end >= t_start").where(F.col("bin") == F.floor(F.greatest("start", "t_start") / bin_lines))
    w = Window.partitionBy("file", "t_start", "t_end").orderBy(F.col("end") - F.col("start"), "id")
    return both.withColumn("rank", F.row_number().over(w)).select("file", "t_start", "t_end", "id", "rank")


def dark(gold: DataFrame, *found: DataFrame) -> DataFrame:
    """Gold ids that no channel finds."""
    for leg in found:
        gold = gold.join(leg.select("id").distinct(), "id", "left_anti")
    return gold


def recall_mrr(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """query, gold, recall_k for each k, rr (of the first gold id). ranked: query, id, rank; gold: query, id."""
    hits = gold.select("query", "id").distinct().join(ranked, ["query", "id"], "left")
    recalls = [(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks]
    return hits.groupBy("query").agg(F.count("*").alias("gold"), *recalls, F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))


def running(df: DataFrame, by: list[str], order: list[str | Column], cost: str, parts: int | None = None) -> DataFrame:
    """df with upto: the sum of cost up to each row of its group, in that order (ties in any order). Rows are dealt out by ranges of (group, order), so that a large group lies in many tasks: sums of its
    ranges, of which there are as many as tasks, tell each range where it starts."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    named = df.withColumns({f"__o{i}": c for i, c in enumerate(columns)})
    keys = [f"__o{i}" for i in range(len(columns))]
    dealt = cut(named.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by, *keys, "__tie").withColumn("__part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "__part").agg(F.sum(cost).alias("n"))
    start = sums.withColumn("__base", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    here = Window.partitionBy(*by, "__part").orderBy(*keys, "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.lit(True)
    for c in [*by, "__part"]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    summed = dealt.withColumn("__upto", F.sum(cost).over(here)).alias("l").join(start.alias("r"), same)
    return summed.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("__upto") + F.col("__base")).alias("upto"))


def until_budget(ranked: DataFrame, by: str, rank: str, cost: str, budget: int, inclusive: bool = True) -> DataFrame:
    """The ranked prefix of each group until its costs reach the budget; inclusive keeps the row that crosses it."""
    summed = running(ranked, [by], [rank], cost)
    return summed.where(F.col("upto") - F.col(cost) < budget) if inclusive else summed.where(F.col("upto") <= budget)


#: Budgets of a curve, in tokens.
BUDGETS = (2000, 5000, 10000, 25000, 50000, 100000)


def budget_curve(ranked: DataFrame, gold: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """query, gold, full, recall_<budget> for each budget: which share of a query's gold ids (query, id) its ranked list (query, id, rank, cost) has when its costs reach the budget, the row that crosses it
    included; and the costs until all gold is found, or of the whole list if some isn't. All budgets come from one running sum."""
    upto = running(ranked.select("query", "id", "rank", F.greatest(F.lit(1), F.col("cost")).alias("cost")), ["query"], ["rank"], "cost")
    wanted = gold.select("query", "id").distinct()
    whole = upto.groupBy("query").agg(F.max("upto").alias("whole"))
    hits = wanted.join(upto, ["query", "id"], "left").groupBy("query", "id").agg(F.min("upto").alias("upto"), F.min_by(F.col("upto") - F.col("cost"), "upto").alias("before"))
    recalls = [(F.count_if(F.col("before") < b) / F.count("*")).alias(f"recall_{b}") for b in budgets]
    found = hits.groupBy("query").agg(F.count("*").alias("gold"), F.count("upto").alias("found"), F.max("upto").alias("last"), *recalls)
    full = F.when(F.col("found") == F.col("gold"), F.col("last")).otherwise(F.coalesce("whole", F.lit(0)))
    return found.join(whole, "query", "left").select("query", "gold", full.alias("full"), *[f"recall_{b}" for b in budgets])


def upper_median(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The middle of the sorted values; of an even number, the upper of the two. Values are counted first, and the counts summed up by ranges, so that no group is sorted in one task."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    upto = cut(running(counts, by, [column], "n"), "counts")
    sizes = upto.groupBy(*by).agg(F.max("upto").alias("size"))
    middle = F.floor(F.col("size") / 2) + 1
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    found = upto.alias("l").join(sizes.alias("r"), same).where((F.col("upto") >= middle) & (F.col("upto") - F.col("n") < middle))
    return found.select(*[F.col(f"l.{c}") for c in by], F.col(column).alias("median"))


# Seeds that every adaptive choice has, and may have.
FLOOR, CAP = 5, 30


def seed_choices(scores: DataFrame, by: str, ks: tuple[int, ...] = (8, 15, 20), alphas: tuple[float, ...] = (0.5, 0.35), masses: tuple[float, ...] = (0.85, 0.9), floor: int = FLOOR, cap: int = CAP) -> DataFrame:
    """by, id, rank and, of each of the best `cap` of a group (by, id, score), whether these choose it, all in one pass: the first k (top_k); a share of the best score, or the first `floor` if fewer reach it (near_alpha); the
    smallest prefix of `floor` or more with a share of the mass above the region's weakest (mass_m); what stands before the widest relative gap from `floor` on, the first of equal ones (knee)."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    region = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(cap, *ks))
    every = Window.partitionBy(by)
    inside = F.col("rank") <= cap
    of = lambda x: F.when(inside, x)
    df = region.withColumn("size", F.count_if(inside).over(every)).withColumn("best", F.max("score").over(every)).withColumn("low", F.min(of(F.col("score"))).over(every))
    df = df.withColumn("mass", of(F.col("score") - F.col("low"))).withColumn("total", F.sum("mass").over(every))
    share = F.col("mass_upto") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    df = df.withColumn("mass_upto", F.sum("mass").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("next", F.lead("score").over(w))
    gap = F.when((F.col("rank") > floor) & (F.col("rank") < F.col("size")), F.when(F.col("score") > 0, (F.col("score") - F.col("next")) / F.col("score")).otherwise(0.0))
    df = df.withColumn("gap", gap).withColumn("widest", F.max("gap").over(every)).withColumn("knee", F.coalesce(F.min(F.when(F.col("gap") == F.col("widest"), F.col("rank"))).over(every), F.col("size")))
    columns = [(F.col("rank") <= k).alias(f"top_{k}") for k in ks]
    for a in alphas:
        df = df.withColumn(f"__a{a}", F.count_if(inside & (F.col("score") >= a * F.col("best"))).over(every))
        columns.append((inside & F.when(F.col(f"`__a{a}`") >= floor, F.col("score") >= a * F.col("best")).otherwise(F.col("rank") <= floor)).alias(f"near_{str(a).partition('.')[2]}"))
    for m in masses:
        df = df.withColumn(f"__m{m}", F.min(F.when(inside & (share >= m) & (F.col("rank") >= floor), F.col("rank"))).over(every))
        columns.append((inside & (F.col("rank") <= F.coalesce(F.col(f"`__m{m}`"), F.lit(cap)))).alias(f"mass_{str(m).partition('.')[2]}"))
    return df.select(by, "id", "rank", *columns, (inside & (F.col("rank") <= F.col("knee"))).alias("knee"))
