"""Typed fields that functions write and read, found in their texts: what signals.field_sides() and field_partners() pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Types of the language's own, names of bases that everything extends, and how fields are written, read and declared.
LIBRARY_TYPES = (
    "String", "Integer", "Long", "Short", "Byte", "Boolean", "Double", "Float", "Character", "Object", "List", "ArrayList", "LinkedList", "Map", "HashMap", "LinkedHashMap", "TreeMap", "Set", "HashSet",
    "Collection", "Optional", "BigDecimal", "BigInteger", "Date", "LocalDate", "LocalDateTime", "Instant", "Calendar", "StringBuilder", "StringBuffer", "Class", "Void", "Number", "Iterable", "Stream", "Arrays",
    "Collections", "Objects", "Math", "System", "Thread", "Exception", "RuntimeException", "Throwable", "File", "Path", "URI", "URL", "Pattern", "Matcher", "UUID", "Duration", "Charset", "T", "E", "K", "V",
)
BASES = r"^Base|^Abstract|^Super|Model$|Entity$|^Object$|DTO$"
WRITTEN = r"(?<![A-Za-z0-9_])(\w+)\.(\w+)\s*(?:[-+*/]?=)(?!=)"
READ = r"(?<![A-Za-z0-9_])(\w+)\.(\w+)\b(?!\s*[=(])"
DECLARED = r"(?:private|protected|public)\s+(?:final\s+)?(?:static\s+)?[\w<>,\[\].]+\s+([a-z]\w*)\s*[;=]"
NO_FIELDS = ("this", "args", "log", "logger")
WORDS = (
    "if", "else", "for", "while", "do", "switch", "case", "return", "new", "public", "private", "protected", "static", "final", "void", "abstract", "class", "interface", "enum", "extends", "implements", "import",
    "package", "this", "super", "try", "catch", "finally", "throw", "throws", "int", "long", "short", "byte", "char", "float", "double", "boolean", "true", "false", "null", "synchronized", "volatile", "transient",
    "instanceof", "break", "continue", "default", "goto", "const", "var", "let", "function", "async", "await", "typeof", "in", "of",
)
ASSIGNED = r"(?<![A-Za-z0-9_])([A-Za-z_]\w*)\s*(?:[-+*/%&|^]?=)(?!=)"
STEPPED = r"([A-Za-z_]\w*)\s*(?:\+\+|--)"
STEPS = r"(?:\+\+|--)\s*([A-Za-z_]\w*)"
NAME = r"(?<![A-Za-z0-9_])([A-Za-z_]\w*)"
MODES = ("filtered", "full", "name", "allvars")


def field_accesses(functions: DataFrame, variables: DataFrame, mode: str = "filtered") -> DataFrame:
    """key, fn, writer: fields that functions (fn, file, cls, text) write or read. variables: file, name, type. The key is the receiver's type and the field, by mode: `filtered`, without library types and collapse-prone bases;
    `full`, with every type; `name`, the field alone; `allvars`, every identifier. A function that writes a field is not its reader."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    every = lambda pattern, group=1: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    if mode == "allvars":
        plain = lambda names: F.filter(F.array_distinct(names), lambda x: ~x.isin(*WORDS) & (F.length(x) > 1))
        written = plain(F.concat(every(ASSIGNED), every(STEPPED), every(STEPS)))
        sides = functions.where("text IS NOT NULL").select("fn", written.alias("w"), plain(every(NAME)).alias("names"))
        legs = [sides.select(F.explode(F.col("w") if writer else F.array_except("names", "w")).alias("key"), "fn", F.lit(writer).alias("writer")) for writer in (True, False)]
        return legs[0].unionByName(legs[1]).distinct()
    pairs = lambda pattern, writer: F.transform(F.arrays_zip(every(pattern).alias("a"), every(pattern, 2).alias("b")), lambda x: F.struct(x["a"].alias("receiver"), x["b"].alias("field"), F.lit(writer).alias("writer")))
    used = functions.where("text IS NOT NULL").select("fn", "file", "cls", F.explode(F.array_distinct(F.concat(pairs(WRITTEN, True), pairs(READ, False)))).alias("x")).select("fn", "file", "cls", "x.*")
    used = used.where((F.length("field") >= 2) & ((F.col("field") != F.upper("field")) | (F.col("field") == F.lower("field"))))
    if mode == "name":
        keyed = used.select(F.col("field").alias("key"), "fn", "writer")
    else:
        types = variables.groupBy(F.col("file").alias("__file"), F.col("name").alias("__name")).agg(F.min("type").alias("type"))
        typed = used.join(types, (F.col("file") == F.col("__file")) & (F.col("receiver") == F.col("__name")), "left")
        typed = typed.withColumn("type", F.when(F.col("receiver") == "this", F.col("cls")).otherwise(F.col("type"))).where(F.col("type").rlike("^[A-Z]"))
        if mode == "filtered":
            typed = typed.where(~F.col("type").isin(*LIBRARY_TYPES) & ~F.col("type").rlike(BASES))
        keyed = typed.select(F.concat_ws(".", "type", "field").alias("key"), "fn", "writer")
    return keyed.groupBy("key", "fn").agg(F.max("writer").alias("writer"))


def fields_of_types(definitions: DataFrame) -> DataFrame:
    """type, field: fields that the bodies of types declare. definitions: type, text."""
    found = definitions.where("text IS NOT NULL").select("type", F.explode(F.regexp_extract_all("text", F.lit(DECLARED), F.lit(1))).alias("field"))
    return found.where((F.length("field") >= 3) & ~F.col("field").isin(*NO_FIELDS)).distinct()


def value_flow(declared: DataFrame, references: DataFrame, least: int = 2) -> DataFrame:
    """rid, file, writes, reads: fields (type, field) as resources that at least so many files touch, where functions that refer to the type set or get them. references: type, file, text. A function that sets a field isn't its reader.
    The patterns are made of each row's field."""
    f, t = F.col("field"), F.col("text")
    cap = F.concat(F.upper(F.substring(f, 1, 1)), F.substring(f, 2, 1000))
    both = references.where("text IS NOT NULL").join(declared, "type").where(t.contains(F.substring(f, 2, 1000)))  # whichever pattern holds, this does; it spares most rows the making of theirs
    writes = t.contains(F.concat(F.lit(".set"), cap, F.lit("("))) | F.regexp_like(t, F.concat(F.lit(r"\."), f, F.lit(r"\s*=[^=]")))
    reads = t.contains(F.concat(F.lit(".get"), cap, F.lit("("))) | t.contains(F.concat(F.lit(".is"), cap, F.lit("("))) | F.regexp_like(t, F.concat(F.lit(r"\."), f, F.lit(r"\b(?!\s*=)")))
    sides = both.select(F.concat(F.lit("field:"), "type", F.lit("."), "field").alias("rid"), "file", writes.alias("w"), reads.alias("r")).where("w OR r")
    files = sides.groupBy("rid", "file").agg(F.bool_or("w").alias("writes"), F.bool_or(F.col("r") & ~F.col("w")).alias("reads"))
    return files.join(files.groupBy("rid").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("rid"), "rid", "left_semi")
