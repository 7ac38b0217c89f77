"""Symbols, calls, imports and typed variables of languages with braces (Java, JavaScript, TypeScript, Go), by DataFrame functions alone.

A text is cut into tokens by one pattern: comments and strings, so that their braces don't count; imports, annotations, the heads of types and functions up to their brace, calls, other braces and semicolons. A running
sum of braces gives each token its depth. Openings and closings of one depth alternate, so an opening is closed by the next token of its depth; and what stands at a depth is enclosed by the last opening of each lesser depth. Windows
are over one file each.

Rows are those of files.PARSED. No grammar is applied: a head is what looks like one, and calls in a head's parameters are not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXTENSIONS = ("java", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go")
MODULE = "<module>"
#: What looks like a function's head or a call, but is none.
NOT_CALLED = ("if", "for", "while", "switch", "catch", "return", "synchronized", "try", "do", "else", "function", "func", "super", "throw", "await", "typeof", "assert", "with", "case", "in", "of", "instanceof", "new")
_NAME = r"[A-Za-z_$][\w$]*"
_STRING = r'"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
_IMPORT = rf"(?m:^[ \t]*import\b[^\n;{{(]*(?:\{{[^}}]*\}}[^\n;]*)?(?:;|$))|\brequire\s*\(\s*(?:{_STRING})\s*\)|(?m:^[ \t]*import\s*\([^)]*\))"
_TYPE = rf"\b(?:class|interface|enum|record|@interface)\s+{_NAME}[^{{}};=\"']*\{{|\btype\s+{_NAME}\s+(?:struct|interface)\s*\{{"
_ARGS = r"\((?:[^()\"'{};]|\([^()]*\))*\)"
_FUNCTION = (
    rf"\bfunc\s*(?:\([^()]*\)\s*)?{_NAME}\s*{_ARGS}[^{{}};\"'\n]*\{{|\bfunction\s*\*?\s*{_NAME}\s*{_ARGS}[^{{}};\"'=]*\{{"
    rf"|\b(?:const|let|var)\s+{_NAME}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\s*\*?\s*{_ARGS}[^{{}};\"']*|(?:{_ARGS}|{_NAME})[^{{}};\"'=]*=>\s*)\{{"
    rf"|(?<![\w$.])(?!(?:{'|'.join(NOT_CALLED)})\b){_NAME}\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+|:\s*[\w<>\[\]|., ]+)?\{{"
)
_MARK = r"@[A-Za-z_][\w.]*(?:\((?:[^()\"']|" + _STRING + r")*\))?"
_CALL = rf"{_NAME}(?:\s*\??\.\s*{_NAME}(?:\(\))?)*\s*\(\s*(?:(?:{_STRING}|[\w.$]+)(?=\s*[,)]))?"
FUNCTION_NAME = rf"^(?:function\b\s*\*?\s*|func\b\s*(?:\([^()]*\)\s*)?|(?:const|let|var)\s+)?({_NAME})"
TOKENS = "|".join([_COMMENT, _IMPORT, _STRING, _TYPE, _FUNCTION, _MARK, _CALL, r"[{};\n]"])


def _whole(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def tokens(files: DataFrame) -> DataFrame:
    """path, at (from 0), token, kind, line, depth (after the token) of each token that isn't a comment, a string or a line feed."""
    found = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(TOKENS), F.lit(0))).alias("at", "token"))
    head = F.regexp_extract("token", rf"({_NAME})\s*\(", 1)
    bare = F.col("token")
    kind = (
        F.when(bare.rlike(r"^(//|/\*)") | bare.rlike("^[\"'`]") | (bare == "\n"), "none")
        .when(bare.isin("{", "}", ";"), bare)
        .when(bare.rlike(r"^\s*import\b") | bare.rlike(r"^require\s*\("), "import")
        .when(bare.rlike(rf"^(class|interface|enum|record|@interface)\s+{_NAME}") & bare.endswith("{"), "class")
        .when(bare.rlike(rf"^type\s+{_NAME}\s+(struct|interface)"), "class")
        .when(bare.startswith("@"), "mark")
        .when(bare.endswith("{"), F.when(F.regexp_extract("token", FUNCTION_NAME, 1).isin(*NOT_CALLED), "{").otherwise("function"))
        .otherwise(F.when(F.regexp_extract("token", rf"({_NAME})\s*\($|({_NAME})\s*\(", 0).isNotNull() & head.isin(*NOT_CALLED), "none").otherwise("call"))
    )
    order = Window.partitionBy("path").orderBy("at")
    breaks = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    leading = F.length(F.regexp_extract("token", r"^\s*", 0)) - F.length(F.replace(F.regexp_extract("token", r"^\s*", 0), F.lit("\n"), F.lit("")))
    step = F.when(F.col("kind").isin("{", "class", "function"), 1).when(F.col("kind") == "}", -1).otherwise(0)
    placed = found.withColumn("kind", kind).withColumn("line", F.sum(breaks).over(order) - breaks + leading + 1).withColumn("depth", F.sum(step).over(order))
    return placed.where("kind <> 'none'")


def parse(files: DataFrame) -> DataFrame:
    """Rows of files.PARSED of the files (path, text) whose extension is one of EXTENSIONS."""
    mine = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*EXTENSIONS)).select("path", F.coalesce("text", F.lit("")).alias("text"))
    every = tokens(mine)
    order = Window.partitionBy("path").orderBy("at")
    # A closing has the depth of what is around it; with one more it has its opening's.
    level = F.when(F.col("kind") == "}", F.col("depth") + 1).otherwise(F.col("depth"))
    braces = every.where("kind IN ('{', '}', 'class', 'function')").withColumn("level", level)
    closed = braces.withColumn("end", F.lead("line").over(Window.partitionBy("path", "level").orderBy("at"))).where("kind <> '}'")
    last = every.groupBy("path").agg(F.max("line").alias("last"))
    text_type = rf"^(?:class|interface|enum|record|@interface|type)\s+({_NAME})"
    name = F.when(F.col("kind") == "class", F.regexp_extract("token", text_type, 1)).when(F.col("kind") == "function", F.regexp_extract("token", FUNCTION_NAME, 1))
    opened = closed.withColumn("name", name).join(last, "path").withColumn("end", F.coalesce("end", "last")).drop("last")
    # What encloses: of each lesser level, the last opening before.
    probes = opened.where("name IS NOT NULL").select("path", "at", (F.col("level") - 1).alias("below")).unionByName(every.where("kind = 'call'").select("path", "at", F.col("depth").alias("below")))
    levels = probes.where("below > 0").select("path", "at", F.explode(F.sequence(F.lit(1), F.col("below").cast("int"))).alias("level"), F.lit(None).cast("struct<name: string, kind: string>").alias("open"), F.lit(True).alias("asks"))
    openings = opened.select("path", "at", F.col("level").cast("int").alias("level"), F.struct("name", "kind").alias("open"), F.lit(False).alias("asks"))
    around = F.last("open", ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, -1))
    nested = levels.unionByName(openings).withColumn("around", around).where("asks AND around.name IS NOT NULL")
    scopes = nested.groupBy("path", "at").agg(F.array_sort(F.collect_list(F.struct("level", "around.name"))).alias("scope")).select("path", "at", F.array_join("scope.name", ".").alias("parent"))
    # Annotations belong to the head that follows them with nothing but annotations between.
    turn = F.sum((F.col("kind") != "mark").cast("int")).over(order) - (F.col("kind") != "mark").cast("int")
    turns = every.withColumn("turn", turn)
    marks = turns.where("kind = 'mark'").groupBy("path", "turn").agg(F.array_sort(F.collect_list(F.struct("at", F.expr("substring(token, 2)").alias("x")))).alias("m")).select("path", "turn", F.col("m.x").alias("decorators"))
    heads = turns.where("kind IN ('class', 'function')").select("path", "at", "turn")
    decorated = heads.join(marks, ["path", "turn"]).select("path", "at", "decorators")
    bases = F.regexp_extract_all(F.regexp_replace(F.regexp_replace("token", r"<[^<>]*>", ""), r"<[^<>]*>", ""), F.lit(rf"(?:\b(?:extends|implements)\s+|,\s*)((?:{_NAME}\.)*{_NAME})"), F.lit(1))
    symbols = opened.where("name IS NOT NULL").join(scopes, ["path", "at"], "left").join(decorated, ["path", "at"], "left")
    qual = F.when(F.col("parent").isNull(), F.col("name")).otherwise(F.concat_ws(".", "parent", "name"))
    type_ = F.when(F.col("kind") == "class", "class").when(F.col("parent").isNotNull() & ~F.col("token").rlike(r"^(const|let|var)\b"), "method").otherwise("function")
    simple = F.array_distinct(F.transform(bases, lambda b: F.element_at(F.split(b, r"\."), -1)))
    none = lambda t: F.lit(None).cast(t)
    strings = lambda: F.array().cast("array<string>")
    symbol_rows = symbols.select("path", F.lit("symbol").alias("row"), qual.alias("qual"), type_.alias("type"), F.col("line").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "name", F.coalesce("parent", F.lit(MODULE)).alias("parent"), F.when(F.col("kind") == "class", simple).otherwise(strings()).alias("bases"), F.coalesce("decorators", strings()).alias("decorators"), none("string").alias("receiver"), none("string").alias("arg0"))
    modules = mine.join(last, "path", "left").select("path", F.lit("symbol").alias("row"), F.lit(MODULE).alias("qual"), F.lit("module").alias("type"), F.lit(1).alias("start"), F.coalesce("last", F.lit(1)).cast("int").alias("end"), F.lit(MODULE).alias("name"), none("string").alias("parent"), none("array<string>").alias("bases"), none("array<string>").alias("decorators"), none("string").alias("receiver"), none("string").alias("arg0"))

    def rows(df: DataFrame, row: str, qual: Column, name: Column, receiver: Column, arg0: Column) -> DataFrame:
        return df.select("path", F.lit(row).alias("row"), qual.alias("qual"), none("string").alias("type"), F.col("line").cast("int").alias("start"), none("int").alias("end"), name.alias("name"), none("string").alias("parent"), none("array<string>").alias("bases"), none("array<string>").alias("decorators"), receiver.alias("receiver"), arg0.alias("arg0"))

    called = F.regexp_replace(F.regexp_extract("token", r"^([^(]*(?:\(\)[^(]*)*)\(", 1), r"\s|\?", "")
    calls = every.where("kind = 'call'").join(scopes, ["path", "at"], "left").withColumn("called", called)
    call_rows = rows(calls, "call", F.coalesce("parent", F.lit(MODULE)), F.element_at(F.split("called", r"\."), -1), F.when(F.col("called").contains("."), F.regexp_extract("called", r"^(.*)\.[^.]*$", 1)).otherwise(""), F.nullif(F.trim(F.regexp_extract("token", rf"\(\s*({_STRING}|[\w.$]+)?$", 1)), F.lit("")))
    one = F.coalesce(F.nullif(F.regexp_extract("token", r"[\"'`]([^\"'`\n]+)[\"'`]", 1), F.lit("")), F.nullif(F.regexp_extract("token", r"^\s*import\s+(?:static\s+)?(\w+(?:\.\w+)*(?:\.\*)?)", 1), F.lit("")))
    many = F.regexp_extract_all("token", F.lit(r"[\"'`]([^\"'`\n]+)[\"'`]"), F.lit(1))
    imported = every.where("kind = 'import'").withColumn("what", F.explode(F.when(F.col("token").rlike(r"^\s*import\s*\("), many).otherwise(F.array(one)))).where("what IS NOT NULL")
    import_rows = rows(imported, "import", F.lit(MODULE), F.element_at(F.split("what", r"[./]"), -1), none("string"), F.col("what"))
    typed = F.concat(
        F.transform(F.regexp_extract_all("text", F.lit(rf"\b([A-Z]\w*)(?:<[^;=(){{}}]*>)?(?:\[\])?\s+[a-z_$][\w$]*\s*[=;,)]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"([a-z_$][\w$]*)\s*[=;,)]$", 1).alias("name"), F.regexp_extract(x, r"^([A-Z]\w*)", 1).alias("of"))),
        F.transform(F.regexp_extract_all("text", F.lit(rf"\b{_NAME}\??\s*:\s*(?:[A-Za-z_]\w*\.)*[A-Z]\w*"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, rf"^({_NAME})", 1).alias("name"), F.regexp_extract(x, r"([A-Z]\w*)$", 1).alias("of"))),
    )
    variables = mine.select("path", F.posexplode(typed).alias("line", "v"))
    variable_rows = rows(variables, "variable", F.lit(MODULE), F.col("v.name"), none("string"), F.col("v.of"))
    return modules.unionByName(symbol_rows).unionByName(call_rows).unionByName(import_rows).unionByName(variable_rows)
