"""Configuration keys: where they are defined, who reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.functions import text as fn

# How code of each language reads a key.
_PLACEHOLDER = r"\$\{\s*([A-Za-z0-9_.\-]+)\s*(?::[^}]*)?\}"
_GET_PROPERTY = r"get(?:Required)?Property(?:Value)?\(\s*[\"']([A-Za-z0-9_.\-]+)[\"']"
_JAVA_ENV = r"System\.get(?:env|Property)\(\s*[\"']([A-Za-z0-9_.\-]+)[\"']"
_PYTHON = r"os\.(?:getenv\(|environ(?:\.get)?[\[(]?)\s*[\"']([A-Za-z0-9_.\-]+)[\"']"
_SCRIPT_DOT = r"process\.env\.([A-Za-z0-9_]+)"
_SCRIPT_INDEX = r"process\.env\[\s*[\"']([A-Za-z0-9_.\-]+)[\"']"
_GO = r"(?:os\.Getenv|viper\.Get\w*)\(\s*[\"']([A-Za-z0-9_.\-]+)[\"']"
READS = {
    ("java", "kt"): (_PLACEHOLDER, _GET_PROPERTY, _JAVA_ENV),
    ("py", "pyi"): (_PYTHON,),
    ("js", "jsx", "ts", "tsx", "mjs", "cjs"): (_SCRIPT_DOT, _SCRIPT_INDEX),
    ("go",): (_GO,),
}


def reads(files: DataFrame) -> DataFrame:
    """path, key, norm_key: each key that a file reads, by the rules of its language. files: path, text."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    keys = F.array().cast("array<string>")
    for exts, patterns in READS.items():
        found = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns])
        keys = F.when(ext.isin(*exts), found).otherwise(keys)
    return files.select("path", F.explode(F.array_distinct(keys)).alias("key")).withColumn("norm_key", fn.config_key(F.col("key")))


def index(definitions: DataFrame, read: DataFrame) -> DataFrame:
    """norm_key, reader, file, line, value: keys that are read, with their definitions if there are any."""
    return read.join(definitions, "norm_key", "left")


def prefix_reads(definitions: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, norm_key: the keys that a prefix binds, itself or anything below it. Keys are opened into their prefixes, so this is an equality."""
    parts = F.split("norm_key", r"\.")
    opened = definitions.select("norm_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("prefix"))
    return opened.join(prefixes.select("prefix").distinct(), "prefix").distinct()


def matches(keys: DataFrame, query: str) -> DataFrame:
    """Keys that are the query, lie below or above it, or, for four characters at least, hold it."""
    q = F.translate(F.lower(F.trim(F.lit(query))), "_-", "..")
    k = F.col("norm_key")
    return keys.where((k == q) | k.startswith(F.concat(q, F.lit("."))) | q.startswith(F.concat(k, F.lit("."))) | ((F.length(q) >= 4) & k.contains(q)))


def divergence(observed: DataFrame, definitions: DataFrame) -> DataFrame:
    """norm_key, value: what was seen live and no file says. Both: norm_key, value."""
    known = observed.join(definitions.select("norm_key").distinct(), "norm_key", "left_semi")
    return known.join(definitions.select("norm_key", "value").distinct(), ["norm_key", "value"], "left_anti")
