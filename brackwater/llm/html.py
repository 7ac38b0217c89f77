"""Main text of web pages by consensus host paths.

Three passes over the pages. The first one looks at each container outside of article and main: a generalised
path (tags and classes from the top down, digits taken out) at which a host's different pages show the same few texts is boilerplate there. The second one scores
each page's containers: the share of the page's readable text that a container covers, times the share of readable text, less links, among all text inside it, so
that a container that leaves out nothing readable wins over the one inside it, and one that takes in nothing else wins over the one around it (ties go to article
and main, then to the deeper one). Each page votes for the path of its best container, and Spark counts the votes of each host. The third pass extracts
each page from the containers at its host's winning path. A page that has no text there, or less than a quarter of what its own best container has, is extracted from that one.

Readable text leaves out boilerplate paths, and menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden elements and reader
comments, told by tag, role, class and id. A header inside article or main is part of it, and there no class or id counts on headings, paragraphs, lists' items, tables or inline elements, and on others only one
that says such a thing as a whole (`related-posts`, not `related-work`). A form, or a class or id that says such things but holds all but a tenth
of what is readable, is the page's frame and leaves nothing out, unless text of an article or main is readable beside it. Character references are decoded after the markup is taken out; inside a block, white space
becomes one space; blocks are joined by one space, in page order. Time and memory are linear in the page, however deep its elements.

Defined cases: a null html is empty and gives an empty text; pages whose url is null or has no host vote together; broken, unclosed
and cut-off markup is read as browsers read it, roughly; CDATA sections are comments; a page without markup is one block; repeated rows each get a row; an empty table
gives no rows; other columns pass through extract(), but for one named main_text, which is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.llm.common import lookup_join, read, ship, stored

#: Different pages of a host that show a path before it can be boilerplate, and how many of them there are at least for each text.
LEAST_PAGES, PAGES_A_TEXT = 2, 2
#: What stands at its host's path is a page's text if it is at least this part, one in so many, of what stands at the path that the page itself would choose.
LEAST_SHARE = 4
_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|$)""", re.S
)
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "math")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements of which a main text may be the content.
_CONTAINERS = frozenset("html body main article section div td center".split())
_CLOSED_BY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements that are left out wherever they stand, and those that may be a page's frame.
_LEFT_OUT_TAGS = frozenset("head nav footer button select menu dialog noscript object applet canvas video audio".split())
_MAYBE_FRAMES = frozenset("form fieldset aside header".split())
_LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_LEFT_OUT_WORDS = frozenset(
    """nav navbar navigation menu submenu topbar header masthead footer foot colophon sidebar side aside rail ad ads adv advert adverts advertisement advertising
    adsense sponsor sponsored sponsors promo promotion banner cookie cookies gdpr consent notice notices alert popup modal overlay newsletter subscribe subscription
    signup login comment comments commentlist disqus replies respond discussion share sharing social follow breadcrumb breadcrumbs crumbs related recommended
    widget widgets pagination pager toolbar search form skip copyright legal disclaimer hidden""".split()
)
#: What may stand beside such a word in the name of furniture; `related-posts` is furniture, `related-work` is not.
_NEUTRAL = frozenset("list lists box block bar section area container wrapper wrap inner items item buttons button links link posts post articles tools thread count top bottom left right inline meta unit slot zone".split())
#: Elements of an article that are text whatever their names say.
_ALWAYS_TEXT = _INLINE | frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption li dl dt dd table tbody tr td th".split())
_WRAPS = frozenset("has with no without is two three col wrap wrapper layout page content main post article entry".split())



_WHOLLY, _MAYBE = 2, 1


def _left_out(tag: str, attrs: str, in_article: bool) -> int:
    """Whether an element is left out: not (0), unless it is the page's frame (1), or wholly (2)."""
    if tag in _LEFT_OUT_TAGS:
        return _WHOLLY
    if tag in _MAYBE_FRAMES and not (tag == "header" and in_article):
        return _MAYBE
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    found = 0
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            if in_article and tag in _ALWAYS_TEXT or re.fullmatch("h[1-6]", tag):
                continue
            for x in value.split():
                words = re.findall(r"[a-z]+", x)
                if not _LEFT_OUT_WORDS.intersection(words):
                    continue
                if in_article or tag in _ALWAYS_TEXT:  # the whole name has to say so
                    if _LEFT_OUT_WORDS.union(_NEUTRAL).issuperset(words):
                        found = _MAYBE
                elif not (len(words) > 1 and words[0] in _WRAPS and words[-1] not in ("comments", "comment", "ad", "ads")):
                    found = _MAYBE
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _WHOLLY
        elif name == "role" and value in _LEFT_OUT_ROLES:
            found = _MAYBE
    return found


def _step(tag: str, attrs: str) -> str:
    found = next(("".join(v) for k, *v in _ATTR.findall(attrs) if k.lower() == "class"), "") if attrs else ""
    return ".".join([tag, *sorted({y for x in found.lower().split() if (y := re.sub(r"\d+", "", x))})])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def path_key(path: str) -> int:
    """The number of a path, made up of its steps from the top down."""
    key = 0
    for step in path.split(">")[1:]:
        key = xxhash.xxh64_intdigest(step, key)
    return key


class Page:
    """blocks: (container, text, characters in links, mark); containers: (parent, step, depth, key of the path, in article or main, mark). Container 0 stands for the whole page. A mark
    is what a left-out element leaves on all it holds: marks has (mark around it, how far it is left out). gone: keys of the host's boilerplate paths."""

    def __init__(self, html: str, gone: frozenset[int] = frozenset()):
        self.containers: list[tuple[int, str, int, int, bool, int]] = [(-1, "", 0, 0, False, 0)]
        self.blocks: list[tuple[int, str, int, int]] = []
        self.marks: list[tuple[int, int]] = [(0, 0)]
        stack: list[tuple[str, int, int, bool]] = []  # tag, container, mark, silent: a left-out inline element, whose words are dropped where they stand
        count: Counter[str] = Counter()  # open elements of each tag
        pieces: list[str] = []
        linked, silent, at = 0, 0, 0  # characters in links of this block; open silent elements
        closes: dict[str, int] = {}

        def flush() -> None:
            nonlocal linked
            if pieces:
                if text := " ".join("".join(pieces).split()):
                    _, where, mark, _ = stack[-1] if stack else ("", 0, 0, False)
                    self.blocks.append((where, text, linked, mark))
                pieces.clear()
            linked = 0

        def say(text: str) -> None:
            nonlocal linked
            if not text:
                return
            if silent:
                pieces.append(" ")
                return
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if count["a"]:
                linked += len(text.strip())

        def cut(k: int) -> None:
            """Closes all elements from the k-th on."""
            nonlocal silent
            while len(stack) > k:
                tag, _, _, quiet = stack.pop()
                count[tag] -= 1
                silent -= quiet

        def innermost(tags: tuple[str, ...], stops: tuple[str, ...] = (), only_inline_between: bool = False) -> int:
            if not any(count[t] for t in tags):
                return -1
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    return k
                if stack[k][0] in stops or only_inline_between and stack[k][0] not in _INLINE:
                    return -1
            return -1

        while m := _TOKEN.search(html, at):
            say(html[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
            if m["end"] or m["end2"]:
                inline = tag in _INLINE
                k = innermost((tag,), only_inline_between=inline)
                if not inline:
                    flush()
                if k >= 0:
                    cut(k)
                continue
            if tag in _VOID:
                if tag in ("br", "hr"):
                    pieces.append(" ")
                    if tag == "hr":
                        flush()
                continue
            if tag in _RAW:
                end = _RAW[tag].search(html, at)
                at = end.end() if end else len(html)
                if tag in ("svg", "math"):
                    pieces.append(" ")
                continue
            if tag in _INLINE:
                _, where, mark, _ = stack[-1] if stack else ("", 0, 0, False)
                quiet = bool(_left_out(tag, attrs, self.containers[where][4]))
                if quiet:  # unless nothing closes it
                    if tag not in closes:
                        closes[tag] = html.lower().rfind(f"</{tag}")
                    quiet = closes[tag] >= at
                stack.append((tag, where, mark, quiet))
                count[tag] += 1
                silent += quiet
                continue
            flush()
            if tag in _CLOSED_BY:
                same = next(({tag, *pair} for pair in (("dt", "dd"), ("td", "th")) if tag in pair), {tag})
                if (k := innermost(tuple(same), _CLOSED_BY[tag])) >= 0:
                    cut(k)
            if (k := innermost(("p",), only_inline_between=True)) >= 0:  # a block ends an open paragraph
                cut(k)
            _, where, mark, _ = stack[-1] if stack else ("", 0, 0, False)
            parent = self.containers[where]
            how = _left_out(tag, attrs, parent[4])
            if how:
                self.marks.append((mark, how))
                mark = len(self.marks) - 1
            if tag in _CONTAINERS:
                step = _step(tag, attrs)
                key = xxhash.xxh64_intdigest(step, parent[3])
                if key in gone and not parent[4]:
                    self.marks.append((mark, _WHOLLY))
                    mark = len(self.marks) - 1
                self.containers.append((where, step, parent[2] + 1, key, parent[4] or tag in ("article", "main"), mark))
                where = len(self.containers) - 1
            stack.append((tag, where, mark, False))
            count[tag] += 1
        say(html[at:])
        flush()
        self.out = self._left_out_marks()

    def _left_out_marks(self) -> list[bool]:
        """Of each mark, whether what has it is left out. A mark that may be the page's frame holds all but a tenth of what would be readable without it."""
        own = [0] * len(self.marks)
        for _, text, _, mark in self.blocks:
            own[mark] += len(text)
        frame = [False] * len(self.marks)
        while True:
            out = [False] * len(self.marks)
            for k, (around, how) in enumerate(self.marks):
                out[k] = bool(k) and (out[around] or how > 0 and not frame[k])
            if any(self.containers[c][4] and not out[mark] for c, _, _, mark in self.blocks):  # an article can be read: nothing left out is its frame
                return out
            readable = sum(n for n, gone in zip(own, out, strict=True) if not gone)
            # The text that each outermost left-out mark holds, but for what further marks in it leave out.
            inside = [0] * len(self.marks)
            free = [True] * len(self.marks)  # nothing but one mark leaves it out
            top = [0] * len(self.marks)
            for k, (around, how) in enumerate(self.marks):
                marked = how > 0 and not frame[k]
                top[k] = top[around] if out[around] else k if marked and k else 0
                free[k] = not (out[around] and marked) and (free[around] if k else True)
                if top[k] and free[k]:
                    inside[top[k]] += own[k]
            best = max(range(len(self.marks)), key=lambda k: inside[k] if self.marks[k][1] == _MAYBE else -1)
            if not best or self.marks[best][1] != _MAYBE or frame[best] or inside[best] <= 9 * readable:
                return out
            frame[best] = True

    def path(self, c: int) -> str:
        steps = []
        while c > 0:
            steps.append(self.containers[c][1])
            c = self.containers[c][0]
        return "".join(f">{x}" for x in reversed(steps))

    def sums(self) -> tuple[list[int], list[int], list[int]]:
        """Of each container: readable characters less those in links, all characters, and a number for its text."""
        good, every, text_key = ([0] * len(self.containers) for _ in range(3))
        for c, text, links, mark in self.blocks:
            good[c] += 0 if self.out[mark] else max(0, len(text) - 2 * links)
            every[c] += len(text)
            text_key[c] += xxhash.xxh64_intdigest(text)
        for c in range(len(self.containers) - 1, 0, -1):  # those inside come after those around them
            parent = self.containers[c][0]
            for x in (good, every, text_key):
                x[parent] += x[c]
        return good, every, text_key

    def shown(self) -> list[tuple[int, int, int]]:
        """The path's key, the page's and the text's number of each container with text outside of article and main."""
        _, every, text_key = self.sums()
        low = (1 << 64) - 1
        return list({(_signed(key), _signed(text_key[0] & low), _signed(text_key[c] & low)) for c, (_, step, _, key, inside, _) in enumerate(self.containers) if c and not inside and every[c]})

    def best(self) -> int:
        """The container with the best score; ties go to article and main, then to the deeper one."""
        good, every, _ = self.sums()
        if not good[0]:
            return 0
        score = lambda c: (round(good[c] / good[0] * (good[c] / every[c]), 9), self.containers[c][1].split(".")[0] in ("article", "main"), self.containers[c][2], -c)
        return max((c for c in range(len(self.containers)) if 3 * good[c] > good[0]), key=score, default=0)

    def text(self, roots: set[int]) -> str:
        inside = []
        for c, (parent, *_) in enumerate(self.containers):
            inside.append(c in roots or parent >= 0 and inside[parent])
        return " ".join(text for c, text, _, mark in self.blocks if inside[c] and not self.out[mark])

    def main_text(self, path: str | None) -> str:
        key = path_key(path) if path else None
        roots = {c for c, x in enumerate(self.containers) if c and x[3] == key}
        found, own = self.text(roots) if roots else "", self.text({self.best()})
        return own if len(found) * LEAST_SHARE < len(own) else found


def vote(html: str, gone: frozenset[int] = frozenset()) -> str | None:
    """The path of the page's best container, if it has one."""
    page = Page(html, gone)
    return page.path(page.best()) or None


def host_of(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_boilerplate(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, gone (array of path keys): where different pages of the host show the same few texts. Copies of a page count once."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *x) for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in Page(t.as_py() or "").shown()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "key", "page", "text"])

    shown = pages.select(host_of(url).alias("host"), html).mapInArrow(look, "host string, key long, page long, text long").distinct()
    texts = shown.groupBy("host", "key", "text").agg(F.count("*").alias("pages"))
    paths = texts.groupBy("host", "key").agg(F.sum("pages").alias("pages"), F.count("*").alias("texts")).where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= PAGES_A_TEXT * F.col("texts")))
    return paths.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("gone"))


def _with_gone(pages: DataFrame, boilerplate: DataFrame, url: str, *more: F.Column) -> DataFrame:
    return lookup_join(pages.select(host_of(url).alias("host"), *more), boilerplate, ["host"], boilerplate.count())


def host_paths(pages: DataFrame, boilerplate: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path: the winner at each host. Ties go to article and main, then to the longer path, then to the first by name."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [vote(x.as_py() or "", _keys(g)) for x, g in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    rows = _with_gone(pages, boilerplate, url, F.col(html).alias("html")).select("host", "html", "gone")
    voted = rows.mapInArrow(score, "host string, path string").where("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"))
    semantic = F.col("path").rlike(r"(^|>)(article|main)[^>]*$")
    return voted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), ~semantic, -F.length("path"), "path")).alias("path"))


def _keys(gone: list[int] | None) -> frozenset[int]:
    return frozenset(x & (1 << 64) - 1 for x in gone or ())


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with main_text (string)."""
    ship(pages.sparkSession)
    boilerplate = stored(host_boilerplate(pages, url, html), "boilerplate")
    winners = stored(host_paths(pages, boilerplate, url, html), "host-paths")
    kept = [c for c in pages.columns if c.lower() != "main_text"]
    known = boilerplate.withColumnRenamed("host", "h").join(winners, F.col("h").eqNullSafe(F.col("host")), "full_outer").select(F.coalesce("host", "h").alias("host"), "gone", "path")
    known = stored(known, "hosts")
    rows = _with_gone(pages, known, url, F.struct(*kept).alias("row"), F.col(html).alias("html"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py() or "", _keys(g)).main_text(p) for h, g, p in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "main_text"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("main_text", T.StringType())])
    return rows.select("row", "html", "gone", "path").mapInArrow(again, schema).select("row.*", "main_text")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
