"""Modules of a source tree from its build files: where they are, what they call themselves, what they declare, and which tree they belong to.

files: path (below a common root, with slashes), text. A module is a folder; the one at the top is ''."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files that make a folder a module, files that mark the outermost one, folders that are passed over, and how far up a tree is followed.
MODULE_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "pyproject.toml", "setup.py", "package.json", "go.mod")
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "pyproject.toml", "setup.py", "setup.cfg", "package.json", "go.mod")
ROOT_MARKERS = ("settings.gradle", "settings.gradle.kts", "pyproject.toml", "pnpm-workspace.yaml", "lerna.json", "nx.json", "go.work")
PASSED_OVER = (".git", "target", "build", "node_modules", ".venv", ".idea", "dist")
MOST_UP = 6
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
ARTIFACT = r"<artifactId>\s*([\w.\-]+)\s*</artifactId>"
GO_NEED = r"(?m)^\s*(?:require\s+)?([\w./\-]+)\s+v\d"
PYTHON_LIST = r"(?s)(?:dependencies|install_requires)\s*=\s*\[(.*?)\]"
PYTHON_NEED = "[\"']([A-Za-z0-9_.\\-]+)"
_PACKAGE = "name string, " + ", ".join(f"{s} map<string, string>" for s in SECTIONS)


def build_files(files: DataFrame) -> DataFrame:
    """dir, file, text of build files and of what marks roots, but for those in folders that are passed over."""
    kept = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, PASSED_OVER))))
    name = F.element_at(F.split("path", "/"), -1)
    return kept.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), name.alias("file"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("file").isin(*BUILD_FILES, *ROOT_MARKERS))


def modules(files: DataFrame) -> DataFrame:
    """dir of each module."""
    return build_files(files).where(F.col("file").isin(*MODULE_FILES)).select("dir").distinct()


def identities(files: DataFrame) -> DataFrame:
    """module (its folder), ecosystem, name: what a module calls itself, by the first of its files that says so: Maven, npm, Go, Python."""
    t = F.col("text")
    own = F.regexp_extract(F.regexp_replace(t, r"(?s)<parent>.*?</parent>", ""), ARTIFACT, 1)
    said = (
        F.when(F.col("file") == "pom.xml", F.struct(F.lit(1).alias("place"), F.lit("mvn").alias("ecosystem"), own.alias("name")))
        .when(F.col("file") == "package.json", F.struct(F.lit(2).alias("place"), F.lit("js").alias("ecosystem"), F.coalesce(F.from_json(t, _PACKAGE)["name"], F.lit("")).alias("name")))
        .when(F.col("file") == "go.mod", F.struct(F.lit(3).alias("place"), F.lit("go").alias("ecosystem"), F.regexp_extract(t, r"(?m)^\s*module\s+(\S+)", 1).alias("name")))
        .when(F.col("file") == "pyproject.toml", F.struct(F.lit(4).alias("place"), F.lit("py").alias("ecosystem"), F.lower(F.regexp_extract(t, r"(?m)^\s*name\s*=\s*[\"']([^\"']+)", 1)).alias("name")))
        .when(F.col("file") == "setup.py", F.struct(F.lit(5).alias("place"), F.lit("py").alias("ecosystem"), F.lower(F.regexp_extract(t, r"name\s*=\s*[\"']([^\"']+)", 1)).alias("name")))
    )
    found = build_files(files).select("dir", said.alias("m")).where("m.name <> ''")
    return found.groupBy("dir").agg(F.min("m").alias("m")).select(F.col("dir").alias("module"), "m.ecosystem", "m.name")


def declared(files: DataFrame) -> DataFrame:
    """module, ecosystem, name: each dependency that a module's build files declare, once."""
    t = F.col("text")
    every = lambda of, pattern: F.regexp_extract_all(of, F.lit(pattern), F.lit(1))
    package = F.from_json(t, _PACKAGE)
    npm = F.concat(*[F.coalesce(F.map_keys(package[s]), F.array().cast("array<string>")) for s in SECTIONS])
    python = F.transform(F.flatten(F.transform(every(t, PYTHON_LIST), lambda block: every(block, PYTHON_NEED))), F.lower)
    named: list[tuple[Column, str, Column]] = [(F.col("file") == "pom.xml", "mvn", every(t, ARTIFACT)), (F.col("file") == "package.json", "js", npm), (F.col("file") == "go.mod", "go", every(t, GO_NEED)), (F.col("file").isin("pyproject.toml", "setup.py"), "py", python)]
    ecosystem, names = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for is_it, eco, found in named:
        ecosystem, names = F.when(is_it, eco).otherwise(ecosystem), F.when(is_it, found).otherwise(names)
    return build_files(files).select(F.col("dir").alias("module"), ecosystem.alias("ecosystem"), F.explode(names).alias("name")).where("name <> ''").distinct()


def project_roots(dirs: DataFrame, files: DataFrame, most: int = MOST_UP) -> DataFrame:
    """dir, root: the outermost module that a folder (dir) belongs to: up from it for as long as parents have build files, `most` levels at most, or to the first parent that marks a root."""
    builds = build_files(files).groupBy("dir").agg(F.bool_or(F.col("file").isin(*ROOT_MARKERS)).alias("marks")).withColumnRenamed("dir", "parent")
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    ups = F.sequence(F.lit(1), F.least(F.lit(most), F.size(parts)))
    parents = dirs.select("dir").distinct().select("dir", F.explode(F.when(F.size(parts) > 0, F.transform(ups, lambda k: F.struct(k.alias("up"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/").alias("parent"))))).alias("p")).select("dir", "p.*")
    known = parents.join(builds, "parent", "left").groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("up", "parent", "marks"))).alias("above"))  # `most` at most
    start = F.struct(F.lit(True).alias("on"), F.lit(None).cast("string").alias("root"))
    step = lambda a, x: F.when(~a["on"] | x["marks"].isNull(), F.struct(F.lit(False).alias("on"), a["root"].alias("root"))).otherwise(F.struct((~x["marks"]).alias("on"), x["parent"].alias("root")))
    found = known.select("dir", F.aggregate("above", start, step)["root"].alias("root"))
    return dirs.select("dir").distinct().join(found, "dir", "left").select("dir", F.coalesce("root", "dir").alias("root"))
