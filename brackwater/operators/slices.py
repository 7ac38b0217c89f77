"""Lines of a method that a line depends on, and that depend on it: a def-use slice to its fixpoint, for all methods at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.storage import cut

# Words that are no variables; what is assigned; what is declared; names.
KEYWORDS = (
    "if", "for", "while", "return", "new", "this", "null", "true", "false", "else", "try", "catch", "throw", "public", "private", "protected",
    "static", "final", "void", "int", "long", "String", "boolean", "class", "import", "package", "switch", "case", "break",
)
ASSIGNED = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*=(?!=)"
DECLARED = r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_<>,\[\].]*\s+([a-z_][A-Za-z0-9_]*)\s*[=;)]"
NAME = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)"


def definitions(text: Column) -> Column:
    """Names that a line assigns or declares."""
    found = F.concat(F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(1)), F.regexp_extract_all(text, F.lit(DECLARED), F.lit(1)))
    return F.filter(F.array_distinct(found), lambda x: ~x.isin(*KEYWORDS))


def uses(text: Column) -> Column:
    """Names of a line that it doesn't define."""
    return F.filter(F.array_except(F.regexp_extract_all(text, F.lit(NAME), F.lit(1)), definitions(text)), lambda x: ~x.isin(*KEYWORDS))


def slices(lines: DataFrame, seeds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """method, line: the seeds (method, line), the definitions above a line of what it uses, the uses below it of what it defines, and so on. lines: method, line, text.

    Each round joins only the lines that the last one added. Of a variable that several of them use, the lowest one has all definitions that the others have,
    and so the join makes a row for each definition at most; likewise with uses."""
    each = lines.where("text IS NOT NULL").select("method", "line", definitions(F.col("text")).alias("defs"), uses(F.col("text")).alias("uses"))
    defs = cut(each.select("method", "line", F.explode("defs").alias("name")), "definitions")
    used = cut(each.select("method", "line", F.explode("uses").alias("name")), "uses")
    front = cut(seeds.select("method", "line").distinct().join(lines.select("method", "line").distinct(), ["method", "line"], "left_semi"), "front")
    found = front
    for _ in range(most_rounds):
        if not front.limit(1).count():
            return found
        above = used.join(front, ["method", "line"], "left_semi").groupBy("method", "name").agg(F.max("line").alias("at"))
        below = defs.join(front, ["method", "line"], "left_semi").groupBy("method", "name").agg(F.min("line").alias("at"))
        feeding = defs.join(above, ["method", "name"]).where("line <= at").select("method", "line")
        fed = used.join(below, ["method", "name"]).where("line >= at").select("method", "line")
        front = cut(feeding.unionByName(fed).distinct().join(found, ["method", "line"], "left_anti"), "front")
        found = cut(found.unionByName(front), "slice")
    raise RuntimeError(f"slices did not settle in {most_rounds} rounds")
