"""What stands in an article stays, whatever its names say; pages unlike their host's keep their own text."""

import pyarrow.parquet as pq
import pytest

from brackwater.llm import html, registry

LONG = "word " * 60
KEPT = [
    '<h2 id="search-algorithms">kept</h2>', '<section id="form-validation"><p>kept</p></section>', '<p class="legal-analysis">kept</p>', '<h2 id="related-work">kept</h2>', '<h2 id="code-comments">kept</h2>',
    '<p>mid <em class="notice">kept</em> sentence</p>', '<div class="menu-design"><p>kept</p></div>', '<table class="social"><tr><td>kept</td></tr></table>', '<p class="copyright">kept</p>', '<blockquote class="comment">kept</blockquote>',
]
GONE = [
    '<div class="share-buttons">gone</div>', '<div class="comments"><p>gone</p></div>', "<aside>gone</aside>", '<div class="related-posts"><a href=x>gone</a></div>', '<section id="comments"><h3>gone</h3><p>gone</p></section>', '<div class="ad-2">gone</div>', '<p hidden>gone</p>',
    '<div class="newsletter-signup">gone</div>', '<ul class="social"><li>gone</li></ul>', "<form><label>gone</label></form>",
]


def test_articles_keep_what_is_theirs():
    for around in ("article", "main"):
        for inside in KEPT + GONE:
            text = html.Page(f"<body><nav>menu</nav><{around}><h1>Title</h1><p>{LONG}</p>{inside}<p>{LONG}</p></{around}></body>").main_text(None)
            assert ("kept" in text, "gone" in text) == (inside in KEPT, False), inside


def test_pages_unlike_their_host(spark):
    usual = lambda i: f"<body><div class='lead'><p>own text {i} {LONG * 3}</p></div><div class='other'><a href='x'>{LONG}{i}</a></div></body>"
    odd = f"<body><div class='lead'><p>teaser</p></div><section class='report'><p>the report {LONG * 4}</p></section></body>"
    rows = [(i, f"http://h.example/{i}", usual(i)) for i in range(8)] + [(100, "http://h.example/odd", odd), (101, "http://h.example/short", "<body><div class='lead'><p>short one</p></div><div class='other'><a href='x'>short</a></div></body>")]
    got = {r["page_id"]: r["main_text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == f"own text 3 {LONG * 3}".strip() and got[100].endswith(f"the report {LONG * 4}".strip()) and got[101] == "short one"


def test_op3_returns_its_contract(spark):
    sf = "/root/testdata/sf0.001"
    df = registry.queries()["op3_html"](spark, sf)
    assert df.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    rows = df.collect()
    assert len(rows) == pq.read_metadata(f"{sf}/pages.parquet").num_rows and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["n_chars"] for r in rows) == pytest.approx(sum(len(html.Page(x or "").main_text(None)) for x in pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist()), rel=0.02)
