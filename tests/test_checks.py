"""Every rule of the catalogue on pages that differ from a good one in one place."""

import datetime as dt

import pytest

from siteglass.operators import checks, facts
from siteglass.sources import discovery, html

from .test_sites import GOOD

WORDS = " ".join(f"word{k}" for k in range(320))
#: A page that passes what a page by itself can pass.
PAGE = GOOD.replace("<h2>Tools", f"<p>{WORDS} <a href='https://other.example/x'>source</a></p><h2>Tools").replace('"image":"i.png"', '"image":"i.png","publisher":"x"').replace("site.test", "site.example").replace("other.test", "other.example").replace('<meta name="viewport"', '<meta property="og:url" content="https://www.site.example/prune"><meta name="viewport"')
URL = "https://www.site.example/prune"
FULL_MAP = '<video src="v.mp4"></video>'
#: code: (what is replaced, by what, the outcome), each a page of its own.
CASES = [
    ("TITLE_MISSING", "How to prune an old apple tree in early spring", "", "fails"),
    ("TITLE_LENGTH", "How to prune an old apple tree in early spring", "Short", "fails"),
    ("TITLE_LENGTH", "", "", "pass"),
    ("TITLE_SCRIPT_MISMATCH", "How to prune an old apple tree in early spring", "Как обрезать старую яблоню ранней весной", "fails"),
    ("TITLE_SCRIPT_MISMATCH", "", "", "pass"),
    ("META_DESCRIPTION_MISSING", 'name="description"', 'name="other"', "fails"),
    ("META_DESCRIPTION_LENGTH", "with the tools you need and the cuts that help the tree most of all.", "", "fails"),
    ("META_DESCRIPTION_LENGTH", "", "", "pass"),
    ("META_DESCRIPTION_REPEATS_TITLE", "A short guide to pruning old apple trees in spring, with the tools you need and the cuts that help the tree most of all.", "How to prune an old apple tree in early spring!", "fails"),
    ("META_DESCRIPTION_REPEATS_TITLE", "", "", "pass"),
    ("H1_MISSING", "<h1>Prune an old apple tree</h1>", "", "fails"),
    ("H1_MULTIPLE", "<h1>Prune an old apple tree</h1>", "<h1>Prune an old apple tree</h1><h1>Another</h1>", "fails"),
    ("H1_MULTIPLE", "<h1>Prune an old apple tree</h1>", "<h1>Prune an old apple tree</h1><h1>PRUNE an old apple tree</h1>", "pass"),
    ("HEADING_SKIP", "<h2>Tools", "<h4>Tools", "fails"),
    ("HEADING_SKIP", "", "", "pass"),
    ("NO_SUBHEADINGS", "<h2>Tools", "<p>Tools", "fails"),
    ("CANONICAL_MISSING", 'rel="canonical"', 'rel="x"', "fails"),
    ("CANONICAL_MISMATCH", 'rel="canonical" href="https://www.site.example/prune"', 'rel="canonical" href="https://www.site.example/other"', "fails"),
    ("CANONICAL_MISMATCH", "", "", "pass"),
    ("CANONICAL_TO_HTTP", 'rel="canonical" href="https://www.site.example/prune"', 'rel="canonical" href="http://www.site.example/prune"', "fails"),
    ("CANONICAL_CONFLICT", '<link rel="canonical"', '<link rel="canonical" href="https://www.site.example/z"><link rel="canonical"', "fails"),
    ("CANONICAL_RELATIVE", 'rel="canonical" href="https://www.site.example/prune"', 'rel="canonical" href="/prune"', "fails"),
    ("CANONICAL_RELATIVE", "", "", "pass"),
    ("DEVELOPMENT_HOST_REFERENCES", 'href="/next"', 'href="https://staging.site.example/next"', "fails"),
    ("DEVELOPMENT_HOST_REFERENCES", "", "", "pass"),
    ("NOINDEX", "max-image-preview:large", "noindex", "fails"),
    ("NOINDEX", "max-image-preview:large", "unavailable_after: 2020-01-01", "fails"),
    ("NOINDEX", "max-image-preview:large", "unavailable_after: 2099-01-01", "pass"),
    ("SNIPPET_RESTRICTED", "max-image-preview:large", "nosnippet", "fails"),
    ("IMAGE_PREVIEW_NOT_LARGE", "max-image-preview:large", "max-image-preview:none", "fails"),
    ("IMAGE_PREVIEW_NOT_LARGE", "", "", "pass"),
    ("IMAGES_MISSING_ALT", 'alt="a saw"', "", "fails"),
    ("IMAGES_MISSING_ALT", "", "", "pass"),
    ("NO_IMAGES", '<img src="/img/saw.jpg" alt="a saw">', "", "fails"),
    ("IMAGES_NOT_INDEXABLE", '<img src="/img/saw.jpg"', '<img srcset="/img/saw.jpg 1x"', "fails"),
    ("IMAGE_FILENAMES_GENERIC", "/img/saw.jpg", "/img/IMG_0012.jpg", "fails"),
    ("IMAGE_FILENAMES_GENERIC", "", "", "pass"),
    ("VIDEO_WITHOUT_METADATA", "<footer>", f"{FULL_MAP}<footer>", "fails"),
    ("VIDEO_WITHOUT_METADATA", "", "", "notApplicable"),
    ("THIN_CONTENT", WORDS, "", "fails"),
    ("THIN_CONTENT", "", "", "pass"),
    ("AUTHOR_MISSING", '"name":"Ann Green"', '"x":"y"', "fails"),
    ("NO_INTERNAL_LINKS", 'href="/', 'href="https://elsewhere.example/', "fails"),
    ("NO_EXTERNAL_SOURCES", "https://other.example", "https://www.site.example", "fails"),
    ("NO_EXTERNAL_SOURCES", "", "", "pass"),
    ("INTERNAL_LINKS_NOFOLLOW", '<a href="/next">', '<a rel="nofollow" href="/next">', "fails"),
    ("INTERNAL_LINKS_NOFOLLOW", '<a href="/next">', '<a rel="nofollow" href="/go/next">', "pass"),
    ("INTERNAL_LINK_VARIANTS", '<a href="/next">', '<a href="http://www.site.example/next">', "fails"),
    ("LINKS_WITHOUT_TEXT", '<a href="/next">next</a>', '<a href="/next"></a>', "fails"),
    ("LINKS_WITHOUT_TEXT", '<a href="/next">next</a>', '<a href="/next"><img alt="next" src="/n.png"></a>', "pass"),
    ("UNCRAWLABLE_LINKS", '<a href="/next">', '<a href="javascript:go()">', "fails"),
    ("LANG_MISSING", '<html lang="en">', "<html>", "fails"),
    ("HREFLANG_INVALID", "<title>", '<link rel="alternate" hreflang="en-UK" href="/uk"><title>', "fails"),
    ("HREFLANG_INVALID", "<title>", '<link rel="alternate" hreflang="zh-Hant-TW" href="/tw"><title>', "pass"),
    ("HREFLANG_INVALID", "", "", "notApplicable"),
    ("HREFLANG_NO_SELF_REFERENCE", "<title>", '<link rel="alternate" hreflang="de" href="/de"><title>', "fails"),
    ("HREFLANG_NO_SELF_REFERENCE", "<title>", '<link rel="alternate" hreflang="en" href="https://www.site.example/prune"><title>', "pass"),
    ("VIEWPORT_MISSING", 'name="viewport"', 'name="x"', "fails"),
    ("OG_TAGS_MISSING", 'property="og:image"', 'property="og:x"', "fails"),
    ("OG_TAGS_MISSING", "", "", "pass"),
    ("OG_URL_MISMATCH", 'property="og:url" content="https://www.site.example/prune"', 'property="og:url" content="https://www.site.example/x"', "fails"),
    ("OG_URL_MISMATCH", "", "", "pass"),
    ("PREVIEW_IMAGE_IS_LOGO", "https://site.example/a.png", "https://site.example/logo.png", "fails"),
    ("PREVIEW_IMAGE_IS_LOGO", "", "", "pass"),
    ("CHARSET_MISSING_OR_LATE", '<meta charset="utf-8">', "", "fails"),
    ("MIXED_CONTENT", 'src="/img/saw.jpg"', 'src="http://site.example/saw.jpg"', "fails"),
    ("MIXED_CONTENT", "", "", "pass"),
    ("META_REFRESH", "<title>", '<meta http-equiv="refresh" content="0; url=/x"><title>', "fails"),
    ("META_REFRESH", "<title>", '<meta http-equiv="refresh" content="300"><title>', "pass"),
    ("LARGE_PAGE", "<footer>", f"<!--{'x' * (1 << 20)}--><footer>", "fails"),
    ("LARGE_PAGE", "<footer>", f"<!--{'x' * (6 << 20)}--><footer>", "notApplicable"),
    ("LCP_IMAGE_LAZY_LOADED", '<img src="/img/saw.jpg"', '<img loading="lazy" src="/img/saw.jpg"', "fails"),
    ("LCP_IMAGE_LAZY_LOADED", "", "", "pass"),
    ("RENDER_BLOCKING_SCRIPTS", "<title>", '<script src="/a.js"></script><title>', "fails"),
    ("RENDER_BLOCKING_SCRIPTS", "<title>", '<script defer src="/a.js"></script><title>', "pass"),
    ("FONT_PRELOAD_WITHOUT_CROSSORIGIN", "<title>", '<link rel="preload" as="font" href="/f.woff2"><title>', "fails"),
    ("FONT_PRELOAD_WITHOUT_CROSSORIGIN", "<title>", '<link rel="preload" as="font" href="/f.woff2" crossorigin><title>', "pass"),
    ("DOM_SIZE_LARGE", "<footer>", "<b></b>" * 1500 + "<footer>", "fails"),
    ("STRUCTURED_DATA_INVALID", '{"@graph"', '{"@graph', "fails"),
    ("STRUCTURED_DATA_INVALID", "", "", "pass"),
    ("DATES_INCONSISTENT", '"dateModified":"2024-01-03"', '"dateModified":"2023-01-03"', "fails"),
    ("DATES_INCONSISTENT", "", "", "pass"),
    ("STRUCTURED_DATA_MISSING", "BlogPosting", "Thing", "fails"),
    ("STRUCTURED_DATA_INCOMPLETE", '"image":"i.png",', "", "fails"),
    ("STRUCTURED_DATA_INCOMPLETE", "", "", "pass"),
    ("AUTHOR_MARKUP_INCOMPLETE", "Ann Green", "By Ann Green, Bo Red", "fails"),
    ("AUTHOR_MARKUP_INCOMPLETE", "", "", "pass"),
    ("ARTICLE_DATE_FORMAT_INVALID", '"datePublished":"2024-01-02T10:00:00Z"', '"datePublished":"January 2, 2024"', "fails"),
    ("ARTICLE_DATE_FORMAT_INVALID", "", "", "pass"),
    ("ARTICLE_HEADLINE_MISMATCH", '"headline":"Prune an old apple tree"', '"headline":"Something else entirely here"', "fails"),
    ("ARTICLE_HEADLINE_MISMATCH", "", "", "pass"),
    ("BREADCRUMB_MISSING", "BreadcrumbList", "Thing", "fails"),
    ("BREADCRUMB_INVALID", '"position":1,', "", "fails"),
    ("BREADCRUMB_INVALID", "", "", "pass"),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [(k, f"run{k}", URL, PAGE.replace(old, new) if old else PAGE) for k, (_, old, new, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "page_id long, site string, url string, html string")
    pages = html.parse_pages(df).selectExpr("*", "timestamp '2024-06-01' AS fetched_at", "2024 AS year")
    return {(r.page_id, r.code): r.outcome for r in checks.evaluate(pages, "site").collect()}


def test_one_change_one_outcome(outcomes):
    wrong = [(code, old[:40], new[:60], want, outcomes[k, code]) for k, (code, old, new, want) in enumerate(CASES) if outcomes[k, code] != want]
    assert wrong == []
    assert all(PAGE.replace(old, new) != PAGE for _, old, new, _ in CASES if old)


def test_facts_of_a_crawl(spark):
    robots = "User-agent: *\nDisallow: /img/\nUser-agent: GPTBot\nDisallow: /"
    alternate = PAGE.replace("<title>", '<link rel="alternate" hreflang="de" href="https://www.site.example/de"><title>')
    german = PAGE.replace('lang="en"', 'lang="de"').replace("How to prune an old apple tree in early spring", "Guide 2019: how to prune an old tree")
    rows = [(1, "s", URL, alternate, robots), (2, "s", "https://www.site.example/de", german, robots), (3, "s", "https://www.site.example/third", PAGE, None)]
    df = spark.createDataFrame(rows, "page_id long, site string, url string, html string, robots string")
    pages = html.parse_pages(df).selectExpr(
        "*", "url AS final_url", "timestamp '2024-06-01' AS fetched_at", "2024 AS year", "'text/html' AS content_type", "CASE WHEN page_id = 1 THEN 'br' END AS content_encoding",
        "CASE WHEN page_id = 1 THEN 'no-store' END AS cache_control", "page_id = 2 AS redirected", "CAST(600 * page_id AS INT) AS preview_width",
    )
    before = spark.createDataFrame([(1, pages.where("page_id = 1").select("page.content_hash").first()[0], "2020-01-01"), (2, "other", "2020-01-01")], "page_id long, previous_hash string, previous_modified string")
    answers = spark.createDataFrame([("https://other.example/source", 404), ("https://www.site.example/next", 301), (URL, 500)], "link string, status int")
    found = facts.gathered(pages, before, answers)
    got = {(r.page_id, r.code): r.outcome for r in checks.evaluate(found, "site").collect()}
    want = {
        "ROBOTS_BLOCKS_GOOGLEBOT": ("pass", "pass", "notApplicable"), "ROBOTS_BLOCKS_RESOURCES": ("fails", "fails", "notApplicable"), "ROBOTS_BLOCKS_AI_SEARCH": ("pass", "pass", "notApplicable"),
        "TITLE_YEAR_OUTDATED": ("pass", "fails", "pass"), "DATE_BUMPED_WITHOUT_CHANGES": ("fails", "pass", "notApplicable"), "BROKEN_LINKS": ("fails", "fails", "fails"), "LINKS_TO_REDIRECTS": ("fails", "fails", "fails"),
        "HREFLANG_NOT_RECIPROCAL": ("fails", "notApplicable", "notApplicable"), "PREVIEW_IMAGE_TOO_SMALL": ("fails", "pass", "pass"), "REDIRECTED": ("pass", "fails", "pass"),
        "HTML_NOT_COMPRESSED": ("pass", "fails", "fails"), "BFCACHE_BLOCKED_BY_NO_STORE": ("fails", "pass", "pass"), "CANONICAL_TARGET_BROKEN": ("notApplicable", "fails", "fails"),
        "TITLE_DUPLICATE": ("fails", "pass", "fails"), "META_DESCRIPTION_DUPLICATE": ("fails", "pass", "fails"), "NEAR_DUPLICATE_CONTENT": ("fails", "fails", "fails"), "KEYWORD_CANNIBALISATION": ("fails", "pass", "fails"),
        "NOT_HTTPS": ("pass", "pass", "pass"),
    }
    assert {code: tuple(got[k, code] for k in (1, 2, 3)) for code in want} == want
    covered = {c for c, *_ in CASES} | set(want)
    assert covered == set(checks.BY_CODE), set(checks.BY_CODE) - covered


def test_language_versions_are_no_duplicates(spark):
    base = "<html{}><head><title>The same title on all</title>{}</head><body><h1>x</h1></body></html>"
    link = '<link rel="alternate" hreflang="en-gb" href="https://a.test/{}">'
    rows = [
        (1, "https://a.test/1", base.format(' lang="en-US"', "")), (2, "https://a.test/2", base.format(' lang="en-GB"', "")),  # both languages exist and differ
        (3, "https://b.test/3", base.format("", "")), (4, "https://b.test/4", base.format(' lang="en"', "")),  # one has none
        (5, "https://c.test/5", base.format("", link.format("x").replace("a.test/x", "c.test/6/"))), (6, "https://c.test/6", base.format("", "")),  # one names the other
        (7, "https://d.test/7", base.format("", "")), (8, "https://d.test/7", base.format("", "")),  # the same address twice
    ]
    df = spark.createDataFrame([(i, u[8:9], u, h) for i, u, h in rows], "page_id long, site string, url string, html string")
    got = {r.page_id: r.outcome for r in checks.evaluate(html.parse_pages(df), "site", ("TITLE_DUPLICATE",)).collect()}
    assert got == {1: "pass", 2: "pass", 3: "fails", 4: "fails", 5: "pass", 6: "pass", 7: "pass", 8: "pass"}


def test_parser_never_raises():
    import json
    import random

    rng = random.Random(3)
    deep = "<div>" * 5000 + "text of it" + "</div>" * 5000
    assert html.parse(deep, "https://a.test/")["element_count"] > 400
    assert html.parse("<a href='/x'>" * 3000, "https://a.test/")["links"] == ["https://a.test/x"]
    assert html.read_json_ld("[" * 100_000) is None
    bits = ["<", ">", "</", "div", "p", "a href=x", "<!--", "-->", "<![CDATA[", "]]>", "<script>", "</script>", "'", '"', "=", "&amp", "&#x110000;", "<!DOCTYPE", "<?x", "\0", "é", "<table><td>", "<svg/>", "<li>", "</p>", "itemprop=author"]
    for _ in range(400):
        html.parse("".join(rng.choice(bits) for _ in range(rng.randrange(60))), rng.choice(["https://a.test/", "", "http://[", None]))

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        return (None, True, 10**12, "\ud800x", "https://a.test/l.png", [value(depth - 1) for _ in range(2)] if depth else 1, {k: value(depth - 1) for k in rng.sample(KEYS, 4)} if depth else {}, {"@id": {"x": 1}})[kind]

    KEYS = ["@id", "@type", "@graph", "name", "author", "image", "logo", "url", "itemListElement", "position", "item", "headline", "datePublished", "keywords", "mainEntity"]
    for _ in range(300):
        node = {k: value(3) for k in KEYS} | {"@type": rng.choice([["BlogPosting", 3], "BreadcrumbList", {"x": 1}, "Organization", "WebSite"])}
        record = html._sound(html.parse(f'<script type="application/ld+json">{json.dumps(node)}</script>', "https://a.test/"))
        assert all(c["position"] is None or abs(c["position"]) < 1 << 31 for c in record["breadcrumbs"] or ())
        json.dumps(record, ensure_ascii=False).encode()


def test_oversized_and_odd_pages_have_no_record(spark):
    rows = [(1, "https://a.test/", "x" * ((5 << 20) + 1)), (2, "https://a.test/", "<p>" + "é" * (3 << 20)), (3, "https://a.test/", None), (4, None, "<p>text"), (5, "https://a.test/", "<title>t</title>")]
    got = {r.page_id: r for r in html.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: (r.page is None, r.page_error) for k, r in got.items()} == {1: (True, "too large"), 2: (True, "too large"), 3: (False, None), 4: (False, None), 5: (False, None)}
    assert got[5].page.title == "t"


def test_robots_line():
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n\nUser-agent: Googlebot\nDisallow: /g # no\n"
    rule = lambda agent, path: discovery.robots_rule(text, agent, f"https://s.test{path}")
    assert rule("X", "/a/c") == (False, 2) and rule("X", "/a/b") == (True, 3) and rule("X", "/q.pdf") == (False, 4) and rule("Googlebot", "/a") == (True, None) and rule("Googlebot", "/g/1") == (False, 7)
    assert discovery.robots_rule(None, "X", "https://s.test/") == (True, None)
    assert dt is not None
