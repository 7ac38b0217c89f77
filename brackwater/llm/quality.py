"""Quality rules with adaptive thresholds, in DataFrame operations only.

Four rates of each document (long, per thousand) are held against fences that follow the data: for each language and source, a mergeable
sketch of each rate gives a lower and an upper quantile, and a document is rejected if a rate lies beyond upper + spread * (upper - lower), or,
for the length of words, below lower - spread * (upper - lower). RULES has the levels and spreads; no value of a rate is fixed anywhere. Symbols: most documents have none or few, and those
that are full of them stand apart; so the fence is the (geometric) middle of the widest gap of the sketch from the 85 % quantile on, if what lies beyond is GAP times as much as what lies before; else what
15 % of a group may have by itself, and four times its distance from the median besides. Repeats of lines and of 5-word windows, which most documents
have none of: the tail of the group, beyond its 99.7 % quantile. Word length: four times the distance of the quartiles beyond them.

The sketch is a histogram whose buckets keep the six leading bits of a value (a relative error of 1/32 at most; values are compared by bucket), so sketches
merge by adding counts: those of the sources of a language give the language's, and those the corpus'. All documents that pass the base rules count. A
group of fewer than LEAST of them takes its language's fences, and a language of fewer the corpus'. Texts are measured once: the measured rows are stored, and the fences are joined to them.

Base rules hold in every group: under 10 words, or over a fifth of the words in repeated 5-word windows, fails.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups like others; rows of
one id are judged each on its own; an empty table gives no rows; other columns pass through quality_verdicts() in `row`.
Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.llm.common import WORD_SPACES, lookup_join, read, settled, stored

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Of each rate: levels of the lower and the upper quantile, per thousand, and the spread.
RULES = {"symbol_rate": (500, 850, 4), "dup_line_rate": (500, 997, 0), "repeat_rate": (500, 997, 0), "word_length": (250, 750, 4)}
#: Rates whose fence is a gap of the sketch, where there is one; how many times as much as before it lies beyond it.
GAPPED, GAP = ("symbol_rate",), 4
LEAST = 200


def quality_stats(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """row (docs' columns, or those of `keep`, as a struct), lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the four rates."""
    space, rest = WORD_SPACES[0], WORD_SPACES[1:]
    words = F.filter(F.split(F.translate("text", rest, space * len(rest)), space), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, WORD_SPACES, "") != "")
    df = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.select(
        "row", "lang", "source", settled(words).alias("words"), settled(lines).alias("lines"),
        F.length(F.translate("text", WORD_SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    kept = ["row", "lang", "source", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    df = df.select(
        "row", "lang", "source", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), settled(F.transform("words", lambda w: F.xxhash64(w))).alias("h"),
    )
    more = ", ".join(f"h[i + {k}]" for k in range(1, WINDOW))
    df = df.select(*kept, settled(F.expr(f"transform(slice(h, 1, greatest(size(h) - {WINDOW - 1}, 0)), (x, i) -> xxhash64(x, {more}))")).alias("windows"))
    # Only texts in which a window recurs sort theirs, with their places.
    recurs = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.select(*kept, settled(F.when(recurs, F.array_sort(F.expr("transform(windows, (x, i) -> named_struct('x', x, 'i', i))")))).alias("s"))
    df = df.select(*kept, settled(F.expr("array_sort(transform(filter(transform(s, (e, j) -> named_struct('i', e.i, 'again', coalesce(e.x = get(s, j - 1).x, false) or coalesce(e.x = get(s, j + 1).x, false))), e -> e.again), e -> e.i))")).alias("at"))
    covered = F.expr(f"coalesce(aggregate(transform(at, (p, j) -> least({WINDOW}, coalesce(get(at, j + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x), 0L)")
    df = df.select(*kept, settled(covered).alias("n_repeat_words"))
    per = lambda n, of: F.expr(f"{n} * 1000 div greatest({of}, 1)").cast("long")
    return df.select(
        *(c for c in kept if c != "n_lines"), "n_repeat_words", ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "word_chars").alias("symbol_rate"), per("n_dup_lines", "n_lines").alias("dup_line_rate"), per("n_repeat_words", "n_words").alias("repeat_rate"), per("word_chars", "n_words").alias("word_length"),
    )


def bucket_of(v: str) -> Column:
    return F.expr(f"CASE WHEN {v} < 64 THEN {v} ELSE shiftleft(shiftright({v}, length(bin({v})) - 6), length(bin({v})) - 6) END")


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n of the documents that pass the base rules: mergeable by adding n."""
    rates = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), F.col(k).alias("v")) for k in RULES])).alias("e")
    return stats.where("not base_failed").select("lang", "source", rates).select("lang", "source", F.col("e.rate").alias("rate"), bucket_of("e.v").alias("bucket")).groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def fences(counts: DataFrame) -> DataFrame:
    """lang, source and, for each rate, low_ and high_: one row for each language and source."""
    of = lambda i: F.create_map(*[F.lit(x) for k, rule in RULES.items() for x in (k, rule[i])])[F.col("rate")]

    def quantiles(group: list[str], level: str) -> DataFrame:
        merged = counts.groupBy(*group, "rate", "bucket").agg(F.sum("n").alias("n"))
        order = Window.partitionBy(*group, "rate").orderBy("bucket")
        up_to = merged.withColumn("upto", F.sum("n").over(order)).withColumn("next", F.lead("bucket").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*group, "rate")))
        at = lambda i: F.min(F.when(1000 * F.col("upto") >= of(i) * F.col("total"), F.col("bucket")))
        wide = (F.col("next") + 1) / (F.col("bucket") + 1)
        gaps = F.when(F.col("rate").isin(*GAPPED) & (1000 * F.col("upto") >= of(1) * F.col("total")) & (wide >= GAP), F.struct(wide.alias("wide"), (-F.col("bucket")).alias("first"), "next"))
        found = up_to.groupBy(*group, "rate").agg(at(0).alias("lower"), at(1).alias("upper"), F.first("total").alias("docs"), F.max(gaps).alias("gap"))
        spread = of(2) * (F.col("upper") - F.col("lower"))
        middle = (F.floor(F.sqrt((1 - F.col("gap.first")) * (F.col("gap.next") + 1))) - 1).cast("long")
        found = found.select(*group, "docs", "rate", (F.col("lower") - spread).alias("low"), F.coalesce(middle, F.col("upper") + spread).alias("high"))
        pick = lambda k, c: F.max(F.when(F.col("rate") == k, F.col(c)))
        return found.groupBy(*group).agg(F.struct(F.max("docs").alias("docs"), *[pick(k, c).alias(f"{c}_{k}") for k in RULES for c in ("low", "high")]).alias(level))

    own, lang, corpus = quantiles(["lang", "source"], "own"), quantiles(["lang"], "of_lang").withColumnRenamed("lang", "lang2"), quantiles([], "of_all")
    chosen = F.when(F.col("own.docs") >= LEAST, F.col("own")).when(F.col("of_lang.docs") >= LEAST, F.col("of_lang")).otherwise(F.col("of_all"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("lang2"))).join(F.broadcast(corpus))  # the corpus has one row
    return both.select("lang", "source", chosen.alias("f")).select("lang", "source", "f.*").drop("docs")


def quality_verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """quality_stats() with kept: false if the base rules or a fence reject the document."""
    stats = stored(quality_stats(docs, text, lang, source, keep), "measured")
    counts = stored(sketches(stats), "sketches")
    limits = stored(fences(counts), "fences")
    joined = lookup_join(stats, limits, ["lang", "source"], limits.count())
    beyond = bucket_of("word_length") < F.col("low_word_length")
    for k in RULES:
        beyond = beyond | (bucket_of(k) > F.col(f"high_{k}"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond).drop(*[f"{c}_{k}" for k in RULES for c in ("low", "high")])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_verdicts(docs, keep=["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def sql_ctes(table: str, prefix: str = "q") -> str:
    """DuckDB: common table expressions that end with {prefix}_verdicts (columns of `table`, row number rn, the statistics, kept)."""
    p = prefix
    level = lambda i: "CASE rate " + " ".join(f"WHEN '{k}' THEN {rule[i]}" for k, rule in RULES.items()) + " END"
    quant = lambda g, t: f"""{p}_{t} AS (
            SELECT {g + ',' if g else ''} rate, max(total) AS docs, min(CASE WHEN 1000 * upto >= {level(0)} * total THEN bucket END) AS lower, min(CASE WHEN 1000 * upto >= {level(1)} * total THEN bucket END) AS upper,
                max(CASE WHEN rate IN ({', '.join(f"'{k}'" for k in GAPPED)}) AND 1000 * upto >= {level(1)} * total AND (nxt + 1) / (bucket + 1) >= {GAP} THEN {{'wide': (nxt + 1) / (bucket + 1), 'first': -bucket, 'next': nxt}} END) AS gap
            FROM (SELECT *, sum(n) OVER (PARTITION BY {g + ',' if g else ''} rate ORDER BY bucket) AS upto, lead(bucket) OVER (PARTITION BY {g + ',' if g else ''} rate ORDER BY bucket) AS nxt, sum(n) OVER (PARTITION BY {g + ',' if g else ''} rate) AS total
                  FROM (SELECT {g + ',' if g else ''} rate, bucket, count(*) AS n FROM {p}_rates GROUP BY {g + ',' if g else ''} rate, bucket))
            GROUP BY {g + ',' if g else ''} rate)"""  # noqa: E731
    bucket = lambda v: f"(CASE WHEN {v} < 64 THEN {v} ELSE ({v} >> (length(bin({v})) - 6)) << (length(bin({v})) - 6) END)"
    return rf"""
        {p}_docs AS (SELECT row_number() OVER () AS rn, * FROM {table}),
        {p}_words AS (SELECT rn, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM {p}_docs),
        {p}_windows AS (SELECT rn, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT rn, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM {p}_words WHERE len(w) >= {WINDOW})),
        {p}_twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM {p}_windows) WHERE c > 1),
        {p}_repeats AS (SELECT rn, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM {p}_twice) GROUP BY rn),
        {p}_lines AS (SELECT rn, count(*) AS n, count(*) - count(DISTINCT x) AS d FROM (SELECT rn, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM {p}_docs) WHERE regexp_matches(x, '{_WORD}') GROUP BY rn),
        {p}_stats AS (
            SELECT d.*, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.d, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
            FROM {p}_docs d JOIN {p}_words w USING (rn) LEFT JOIN {p}_lines l USING (rn) LEFT JOIN {p}_repeats r USING (rn)),
        {p}_measured AS (
            SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, n_symbols * 1000 // greatest(word_chars, 1) AS symbol_rate,
                n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate, n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 1000 // greatest(n_words, 1) AS word_length
            FROM {p}_stats),
        {p}_rates AS (
            SELECT lang, source, rate, {bucket('v')} AS bucket FROM (
                {' UNION ALL '.join(f"SELECT lang, source, '{k}' AS rate, {k} AS v FROM {p}_measured WHERE NOT base_failed" for k in RULES)})),
        {quant('lang, source', 'own')}, {quant('lang', 'lang')}, {quant('', 'all')},
        {p}_fences AS (
            SELECT lang, source, rate, lower - {level(2)} * (upper - lower) AS low, coalesce(CAST(floor(sqrt((1 - gap."first") * (gap."next" + 1))) AS BIGINT) - 1, upper + {level(2)} * (upper - lower)) AS high FROM (
                SELECT o.lang, o.source, o.rate, CASE WHEN o.docs >= {LEAST} THEN o.lower WHEN l.docs >= {LEAST} THEN l.lower ELSE a.lower END AS lower,
                    CASE WHEN o.docs >= {LEAST} THEN o.upper WHEN l.docs >= {LEAST} THEN l.upper ELSE a.upper END AS upper,
                    CASE WHEN o.docs >= {LEAST} THEN o.gap WHEN l.docs >= {LEAST} THEN l.gap ELSE a.gap END AS gap
                FROM {p}_own o JOIN {p}_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate JOIN {p}_all a ON o.rate = a.rate)),
        {p}_verdicts AS (
            SELECT m.*, NOT base_failed AND NOT EXISTS (
                SELECT 1 FROM {p}_fences f WHERE f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
                    AND ({' OR '.join(f"(f.rate = '{k}' AND {bucket('m.' + k)} > f.high)" for k in RULES)} OR (f.rate = 'word_length' AND {bucket('m.word_length')} < f.low))) AS kept
            FROM {p}_measured m)"""


SQL = {"op1_quality": f"WITH {sql_ctes('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_verdicts"}
