"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

The words of each cell (source, language, topic) are raked until the shares of sources, of languages and of topics are the
targets', one margin after the other, SWEEPS times. A cell's rate is its raked share over its own; a document of the cell
is kept with probability min(1, k * rate), where k is such that BUDGET of the corpus' words are kept on average. A document's lot
is a hash of its id, so it is the same in every run, and rows of one id are kept or left together.

Targets are given for a margin as {value: weight}, where OTHERS stands for each value that is not named (weight 0 without it), or as a power: the weight
of a value is then its share of the words to that power (0: all values alike; 1: as they are). Margins without targets have the power TEMPER.
residuals() says how far each margin's raked shares are from its targets. Topics are by form and length (topic_of()) unless a column is named.

Defined cases: null sources, languages and topics are values like others; a null text has no words and a null id counts as the text "";
documents without words go by their cell's probability; if targets leave no cell any weight, nothing is kept; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.llm.common import WORD_SPACES, lookup_join, read, stored

MARGINS = ("source", "lang", "topic")
TEMPER = 0.7
OTHERS = "*"
#: What op8 mixes to: English twice as much as each other language, sources by the root of their sizes, topics tempered.
TARGETS = {"lang": {"en": 2.0, OTHERS: 1.0}, "source": 0.5, "topic": TEMPER}
BUDGET = 0.6
SWEEPS, AT_ONCE = 12, 4
FILLS = 6
SEED = "mix-1"
#: Cells that one task rakes at most; more are dealt by margin.
ONE_TASK_CELLS = 100_000


def words_in(text: str = "text") -> Column:
    space, rest = WORD_SPACES[0], WORD_SPACES[1:]
    return F.size(F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), rest, space * len(rest)), space), lambda w: w != "")).cast("long")


def topic_of(text: str = "text", words: str = "tokens") -> Column:
    """A topic by form: tables and markup, then notes, articles and books by length."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.when(F.coalesce(marks, F.lit(0)) * 20 > F.coalesce(F.length(text), F.lit(0)), "marked").when(F.col(words) < 150, "note").when(F.col(words) < 1000, "article").otherwise("book")


def lot(key: str = "doc_id", seed: str = SEED) -> Column:
    """Between 0 and 1, by the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cells_of(measured: DataFrame) -> DataFrame:
    return measured.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))


def raked(cells: DataFrame, targets: dict[str, dict[str | None, float] | float] | None = None, temper: float = TEMPER, budget: float = BUDGET, one_task_cells: int = ONE_TASK_CELLS) -> DataFrame:
    """cells with share (of the words, raked), aim_source, aim_lang, aim_topic and probability."""
    targets = {m: temper for m in MARGINS} | (targets or {})
    cells = stored(cells, "cells")
    small = cells.count() <= one_task_cells
    deal = lambda df: df.coalesce(1) if small else df  # noqa: E731  all windows of a sweep then run in one task, without a shuffle
    total = cells.agg(F.sum("tokens")).first()[0] or 0

    def with_sum(df: DataFrame, m: str) -> DataFrame:
        """df with got, the margin's share of each row's value."""
        if small:
            return df.withColumn("got", F.sum("share").over(Window.partitionBy(m)))
        sums = stored(df.groupBy(m).agg(F.sum("share").alias("got")), "margin")
        return lookup_join(df, sums, [m], sums.count())

    df = deal(cells.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))))
    for m in MARGINS:
        df = with_sum(df, m)
        if isinstance(targets[m], dict):
            named = {k: max(w, 0.0) for k, w in targets[m].items() if k != OTHERS}
            weight = F.lit(float(max(targets[m].get(OTHERS, 0.0), 0.0)))
            for value, w in named.items():
                weight = F.when(F.col(m).eqNullSafe(F.lit(value)), F.lit(float(w))).otherwise(weight)
            df = df.withColumn(f"aim_{m}", weight).drop("got")
        else:
            df = df.withColumn(f"aim_{m}", F.when(F.col("got") > 0, F.pow("got", F.lit(float(targets[m])))).otherwise(0.0)).drop("got")
    df = stored(df, "aims")
    for m in MARGINS:
        norm = df.groupBy(m).agg(F.first(f"aim_{m}").alias("a")).agg(F.sum("a")).first()[0] or 1.0
        df = df.withColumn(f"aim_{m}", F.col(f"aim_{m}") / F.lit(norm))
    for _ in range(SWEEPS // AT_ONCE):
        df = deal(df)
        for m in MARGINS * AT_ONCE:
            df = with_sum(df, m).withColumn("share", F.when(F.col("got") > 0, F.col("share") * F.col(f"aim_{m}") / F.col("got")).otherwise(0.0)).drop("got")
        df = stored(df, "raked")
    df = df.withColumn("rate", F.when(F.col("tokens") > 0, F.col("share") * F.lit(float(total)) / F.col("tokens")).otherwise(0.0))
    k = budget
    for _ in range(FILLS):  # cells that give all they have leave their part of the budget to the others
        full, rest = df.agg(F.sum(F.when(F.col("rate") * k >= 1, F.col("tokens"))), F.sum(F.when(F.col("rate") * k < 1, F.col("rate") * F.col("tokens")))).first()
        if rest:
            k = max(k, (budget * total - (full or 0)) / rest)
    return df.select(*MARGINS, "tokens", "share", *[f"aim_{m}" for m in MARGINS], F.least(F.lit(1.0), F.col("rate") * F.lit(k)).alias("probability"))


def residuals(cells: DataFrame) -> DataFrame:
    """margin, value, aim, share, residual (share less aim) of each value of each margin of raked() cells; a value whose cells are all empty keeps its aim as residual."""
    legs = [cells.groupBy(F.col(m).cast("string").alias("value")).agg(F.first(f"aim_{m}").alias("aim"), F.sum("share").alias("share")).select(F.lit(m).alias("margin"), "value", "aim", "share", (F.col("share") - F.col("aim")).alias("residual")) for m in MARGINS]
    return legs[0].unionByName(legs[1]).unionByName(legs[2])


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, targets: dict[str, dict[str | None, float] | float] | None = None, temper: float = TEMPER, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """row (docs' columns as a struct), source, lang, topic, tokens, probability, residual (the greatest of its cell's three margins) and kept for each row of docs."""
    measured = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), *([F.col(topic).cast("string").alias("topic")] if topic else []), words_in(text).alias("tokens"))
    if not topic:
        measured = measured.withColumn("topic", topic_of())
    cells = stored(raked(cells_of(measured), targets, temper, budget), "probabilities")
    for m in MARGINS:
        off = residuals(cells).where(F.col("margin") == m).select(F.col("value").alias(m), F.abs("residual").alias(f"off_{m}"))
        cells = lookup_join(cells.withColumn(m, F.col(m).cast("string")), off, [m], off.count())
    cells = stored(cells.select(*MARGINS, "probability", F.greatest(*[f"off_{m}" for m in MARGINS]).alias("residual")), "chances")
    joined = lookup_join(measured.select("row", "key", *MARGINS, "tokens"), cells, list(MARGINS), cells.count())
    return joined.withColumn("kept", lot("key", seed) < F.col("probability")).drop("key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, its probability (six places), how far its cell's margins are from TARGETS (five places) and whether it is kept."""
    found = mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), targets=TARGETS)
    return found.select("row.doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), F.round("residual", 5).alias("residual"), "kept")


def sql_ctes(table: str, prefix: str = "m", targets: dict[str, dict[str | None, float] | float] | None = None) -> str:
    """DuckDB: common table expressions that end with {prefix}_mixed: the rows of `table`, numbered rn, with topic, tokens, probability, residual and kept."""
    p = prefix
    targets = {m: TEMPER for m in MARGINS} | (targets or {})

    def weight(m: str) -> str:
        if isinstance(targets[m], dict):
            return "CASE " + " ".join(f"WHEN {m} = '{k}' THEN {w}" for k, w in targets[m].items() if k != OTHERS) + f" ELSE {targets[m].get(OTHERS, 0.0)} END"
        return f"CASE WHEN own_{m} > 0 THEN pow(own_{m}, {targets[m]}) ELSE 0 END"

    same = " AND ".join(f"d.{m} IS NOT DISTINCT FROM c.{m}" for m in MARGINS)
    sql = rf"""
        {p}_words AS (SELECT row_number() OVER () AS rn, *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM {table}),
        {p}_docs AS (SELECT *, CASE WHEN coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) * 20 > coalesce(length(text), 0) THEN 'marked'
            WHEN tokens < 150 THEN 'note' WHEN tokens < 1000 THEN 'article' ELSE 'book' END AS topic FROM {p}_words),
        {p}_cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM {p}_docs GROUP BY source, lang, topic),
        {p}_total AS (SELECT sum(tokens) AS t FROM {p}_cells),
        {p}_s0 AS (SELECT c.*, tokens / greatest(t, 1) AS share, {', '.join(f"sum(tokens / greatest(t, 1)) OVER (PARTITION BY {m}) AS own_{m}" for m in MARGINS)} FROM {p}_cells c, {p}_total),
        {p}_a0 AS (SELECT *, {', '.join(f"{weight(m)} AS raw_{m}" for m in MARGINS)} FROM {p}_s0),
        {p}_r0 AS (SELECT source, lang, topic, tokens, share, {', '.join(f"raw_{m} / (SELECT sum(a) FROM (SELECT max(raw_{m}) AS a FROM {p}_a0 GROUP BY {m})) AS aim_{m}" for m in MARGINS)} FROM {p}_a0)"""
    k = 0
    for m in MARGINS * SWEEPS:
        sql += f""",
        {p}_r{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN g > 0 THEN share * aim_{m} / g ELSE 0 END AS share, {', '.join(f"aim_{x}" for x in MARGINS)} FROM (SELECT *, sum(share) OVER (PARTITION BY {m}) AS g FROM {p}_r{k}))"""
        k += 1
    sql += f""",
        {p}_rates AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN share * t / tokens ELSE 0 END AS rate,
            greatest({', '.join(f"abs(sum(share) OVER (PARTITION BY {m}) - aim_{m})" for m in MARGINS)}) AS residual FROM {p}_r{k}, {p}_total),
        {p}_k0 AS (SELECT CAST({BUDGET} AS DOUBLE) AS k)"""
    for i in range(FILLS):
        sql += f""",
        {p}_k{i + 1} AS MATERIALIZED (SELECT CASE WHEN rest > 0 THEN greatest(k, ({BUDGET} * t - coalesce(gone, 0)) / rest) ELSE k END AS k FROM (
            SELECT k, sum(CASE WHEN rate * k >= 1 THEN tokens END) AS gone, sum(CASE WHEN rate * k < 1 THEN rate * tokens END) AS rest FROM {p}_rates, {p}_k{i} GROUP BY k), {p}_total)"""
    return (
        sql
        + f""",
        {p}_mixed AS (SELECT d.*, least(1.0, rate * k) AS probability, residual, CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < least(1.0, rate * k) AS kept
            FROM {p}_docs d JOIN {p}_rates c ON {same}, {p}_k{FILLS})"""
    )


SQL = {"op8_mixing": f"WITH {sql_ctes('documents', targets=TARGETS)} SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, round(residual, 5) AS residual, kept FROM m_mixed"}
