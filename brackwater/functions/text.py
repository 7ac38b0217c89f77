"""Scalar functions on names, keys, paths and messages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the engine this one matches treats specially.
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "was", "one", "our", "out",
    "has", "this", "that", "with", "from", "have", "will", "when", "what", "which", "should", "would",
    "could", "there", "their", "about", "into", "than", "then", "them", "these", "those", "issue", "error",
    "code", "test", "tests", "file", "files", "function", "method", "class", "return", "value", "values",
    "expected", "actual", "following", "example", "https", "http", "com", "github",
)
LOW_RELEVANCE_DIRS = (
    "/test/", "/tests/", "/__tests__/", "/testdata/", "/fixtures/", "/mocks/", "/mock/", "/examples/", "/example/",
    "/samples/", "/sample/", "/generated/", "/migrations/", "/migration/", "/node_modules/",
)
LOW_RELEVANCE_ENDS = (
    "test.java", "tests.java", "it.java", "itcase.java", "_test.py", "_test.go", ".test.js", ".test.ts", ".test.jsx",
    ".test.tsx", ".spec.js", ".spec.ts", ".spec.jsx", ".spec.tsx", ".spec.java",
)
LOW_RELEVANCE = 0.25
PASSAGE, OVERLAP, BODY_TOKENS = 1400, 200, 600
TEST_PATH = r"(?i)(/test/|/tests/|/it/|test\.java$|tests\.java$|it\.java$|itcase\.java$|_test\.|\.test\.|\.spec\.|__tests__)"
FIX_MESSAGE = r"(?i)\b(fix|bug|hotfix|revert|regression|incident|broke|broken)\b|修复|错误|问题"
BOT_AUTHOR = r"(?i)\[bot\]|dependabot|renovate|github-actions"
SKIPPED_MESSAGE = r"(?i)\b(merge|bump|release|lint|format|typo|changelog|deps|vendor)\b"
INFRA_TYPE = r"(Constants?|OperateType|TraceLog|Mapper|Service|ServiceI|Controller|Repository|Config|Utils?|Factory|Exception|Test|Application|Aspect|Filter|Builder|Cmd|CmdExe|Qry|Gateway|GatewayImpl|Properties|Enum)$"
DATA_TYPE = r"(DTO|VO|DO|CO|BO|Entity|Model|Request|Response|Event|Form|Bean|Payload|Record|Result|Data|Info|Message|Settings|Config|State|Snapshot)$"
NON_DATA_TYPE = r"(Impl|Transformer|Client|Handler|Manager|Listener|Provider|Resolver|Validator|Interceptor|Aspect|Filter|Job|Task|Runner|Scheduler|Executor|Helper)$"
RECENCY_BASE, HALF_SCALE = 2.718, 180 * 86400


def subtokens(name: Column) -> Column:
    """Lower-cased parts of a name, split at case changes and non-alphanumerics; of two characters at least."""
    spaced = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]", " "), "([a-z0-9])(?=[A-Z])", "$1 ")
    return F.filter(F.split(F.lower(spaced), " +"), lambda t: F.length(t) >= 2)


def identifiers(text: Column, most: int | None = None) -> Column:
    """Identifiers of three characters at least, lower-cased, repeats included; the first `most` if given (BODY_TOKENS for one passage)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), F.lower)
    return found if most is None else F.slice(found, 1, most)


def seeds(title: Column, body: Column) -> Column:
    """Names that a task text mentions: in backticks and fences, in tracebacks, called, behind a dot, in Pascal, camel or snake case; plain
    words of the title from four letters; file paths, without a leading ./, and their base names. Stop words are left out."""
    both = F.concat_ws("\n", title, body)
    every = lambda pattern, group=1: F.regexp_extract_all(both, F.lit(pattern), F.lit(group))
    names = F.flatten(F.transform(F.concat(every(r"`([^`]+)`"), every(r"(?s)```[^\n]*\n(.*?)```")), lambda x: F.regexp_extract_all(x, F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))))
    dotted = F.flatten(F.transform(every(r"\b[A-Za-z_]\w+(?:\.[A-Za-z_]\w+)+\b", 0), lambda x: F.slice(F.split(x, r"\."), 2, 99)))
    words = every(r"[A-Za-z_][A-Za-z0-9_]{2,}", 0)
    cased = F.filter(words, lambda w: w.rlike(r"^[A-Z].*[a-z]") | (w.rlike(r"^.+[A-Z]") & w.rlike("[a-z]")) | w.contains("_"))
    plain = F.filter(F.regexp_extract_all(title, F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), lambda w: F.length(w) >= 4)
    named = F.concat(every(r"[\w./-]+\.(?:py|pyi|js|jsx|ts|tsx|java|go)\b", 0), every(r'File "([^"]+)", line \d+, in \w+'))
    paths = F.concat(F.transform(named, lambda x: F.regexp_replace(x, r"^[./]+", "")), F.transform(named, lambda x: F.element_at(F.split(x, "/"), -1)))
    traced = every(r'File "[^"]+", line \d+, in (\w+)')
    found = F.concat(names, traced, every(r"\b([A-Za-z_]\w{2,})\s*\("), dotted, cased, plain)
    kept = F.filter(F.array_distinct(found), lambda w: ~F.lower(w).isin(*STOPWORDS) & (F.length(w) >= 3))
    return F.array_sort(F.array_distinct(F.concat(kept, paths)))


def passages(text: Column, size: int = PASSAGE, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of a text; one at least."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def task_text(text: Column) -> Column:
    return F.substring(text, 1, 2000)


def norm_key(arg: Column) -> Column:
    """A resource key: no white space, no quotes around, placeholders emptied, 80 characters at most; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(arg, r"\s+", ""), "^[\"'`]+|[\"'`]+$", "")
    return F.nullif(F.substring(F.regexp_replace(bare, r"\$\{[^}]*\}", "{}"), 1, 80), F.lit(""))


def first_literal(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "[\"'`]([^\"'`]+)[\"'`]", 1), F.lit(""))


def last_name(receiver: Column) -> Column:
    """The last dotted part of a receiver, up to its parenthesis; empty if there is none."""
    return F.substring_index(F.coalesce(F.element_at(F.split(receiver, r"\."), -1), F.lit("")), "(", 1)


def config_key(key: Column) -> Column:
    """Dotted, snake and kebab spellings of a key become one."""
    return F.translate(F.lower(F.trim(key)), "_-", "..")


def recency_weight(newest: Column, at: Column) -> Column:
    """0.5 to 1, halving towards 0.5; times are seconds."""
    return 0.5 + 0.5 * F.pow(F.lit(RECENCY_BASE), -F.greatest(F.lit(0), newest - at) / F.lit(float(HALF_SCALE)))


def low_relevance(path: Column) -> Column:
    p = F.concat(F.lit("/"), F.lower(path))
    base = F.element_at(F.split(p, "/"), -1)
    found = base.startswith("test_") | (base == "conftest.py")
    for d in LOW_RELEVANCE_DIRS:
        found = found | p.contains(d)
    for e in LOW_RELEVANCE_ENDS:
        found = found | p.endswith(e)
    return found


def relevance(path: Column) -> Column:
    return F.when(low_relevance(path), F.lit(LOW_RELEVANCE)).otherwise(F.lit(1.0))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_test_path_for_display(path: Column) -> Column:
    p = F.lower(path)
    ends = F.lit(False)
    for e in ("test.java", ".test.ts", ".test.js", ".spec.ts", ".spec.js"):
        ends = ends | p.endswith(e)
    return p.contains("/test") | p.contains("test_") | ends | p.contains("/spec/") | p.contains("__tests__")


def tickets(message: Column) -> Column:
    """Ids like #12 (as 12) and ABC-7, in order."""
    return F.transform(F.regexp_extract_all(message, F.lit(r"(#\d+|\b[A-Z][A-Z0-9]+-\d+\b)"), F.lit(1)), lambda t: F.ltrim(t, F.lit("#")))


def is_fix(message: Column) -> Column:
    return message.rlike(FIX_MESSAGE)


def env_label(given: Column, traced: Column, profile: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(traced, F.lit("")), F.nullif(profile, F.lit("")), F.lit("default"))


def is_test_env(env: Column, profile: Column) -> Column:
    return F.lower(F.coalesce(env, F.lit(""))).contains("test") | F.lower(F.coalesce(profile, F.lit(""))).contains("test") | (env == "default")


def name_suffixes(qual: Column) -> Column:
    """Of a runtime name, longest first, every dotted suffix; lambdas count as the method that holds them, and $ as a dot."""
    plain = F.translate(F.regexp_replace(qual, r"lambda\$([^$]+)\$\d+", "$1"), "$", ".")
    parts = F.split(plain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def type_class(name: Column) -> Column:
    """infra, data or other, by the endings of a type's name."""
    return F.when(name.rlike(INFRA_TYPE) & ~name.rlike(DATA_TYPE), "infra").when(name.rlike(DATA_TYPE) & ~name.rlike(NON_DATA_TYPE), "data").otherwise("other")


def redacted(key: Column, value: Column) -> Column:
    """Values whose key names a secret are hidden."""
    return F.when(key.rlike("(?i)(password|passwd|secret|token|credential|api_?key|private_?key)"), "***").otherwise(value)


def l2_normalised(vector: Column) -> Column:
    """A vector of unit length; of zeros, itself."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def span_hash(text: Column) -> Column:
    """The first 16 hex digits of a span's SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def span_text(text: Column, start: Column, end: Column) -> Column:
    """The lines of a text from start to end, both included, from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(F.lit(0), end - start + 1)), "\n")
