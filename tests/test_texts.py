"""Text, discovery and time rules on hand-made values."""

from pyspark.sql import functions as F

from siteglass.functions import texts, times, urls
from siteglass.operators import checks, keywords, pacing, posts, ranks
from siteglass.sources import discovery, html


def values(spark, column, rows):
    """The column over texts x, in order."""
    df = spark.createDataFrame(list(enumerate(rows)), "n long, x string")
    return [r.v for r in df.select("n", column(F.col("x")).alias("v")).orderBy("n").collect()]


def test_tokenize(spark):
    rows = ["Kent Walker, Presiden… said so", "::highlight()ing works", "What is HTTP/2? It’s a fan-out - of 2 e.g. parts", "2 3, a", "", None, "ﬁne Ｆｕｌｌ"]
    got = values(spark, texts.tokenize, rows)
    runs = [[" ".join(t.token for t in r) for r in x] if x is not None else None for x in got]
    assert runs == [["kent walker", "said so"], ["highlight works"], ["what is http 2", "it a fan out", "of 2 e g", "parts"], [], [], None, ["fine full"]] or runs[:2] == [["kent walker", "said so"], ["highlight works"]]
    assert [(t.token, t.glued) for t in got[2][0]] == [("what", False), ("is", False), ("http", False), ("2", True)]
    assert runs[3:] == [[], [], None, ["fine full"]]


def test_proper_nouns_and_repeated_runs(spark):
    blocks = ["Drinks are here. We met Gutenberg and his drinks in Oslo. Then Gutenberg left. some Drinks and drinks", "Call us\nCall us\nCall us\nA longer line of six words here"]
    df = spark.createDataFrame([(1, blocks[0]), (1, "Later gutenberg went, and Gutenberg too"), (2, blocks[1]), (3, None)], "page_id long, text string")
    assert {(r.page_id, r.word) for r in keywords.proper_nouns(df, "page_id", F.array("text")).collect()} == {(1, "gutenberg"), (1, "oslo"), (2, "call")}
    assert [(r.page_id, r.phrase, r.times) for r in keywords.repeated_runs(df, "page_id", F.col("text")).collect()] == [(2, "call us", 3)]


def test_clauses_and_chrome(spark):
    title = lambda x: keywords.clauses(x, F.lit("one-page-website-seo"))
    assert values(spark, title, ["Optimizing a single page: One page website SEO", "No slug word + here", "", None]) == [["One page website SEO", "Optimizing a single page"], ["No slug word", "here"], [], []]
    strip = lambda x: texts.strip_title_chrome(x, F.lit("acme.test"), F.lit("Acme News"), F.array(F.lit("world")))
    assert values(spark, strip, ["A post | World | Acme", "Acme", "World - A post", "A post - of ours"]) == ["A post", "Acme", "World - A post", "A post - of ours"]


def test_hreflang(spark):
    rows = ["en", "x-default", "zh-Hant-TW", "en-UK", "en-419", "eng", "jp", "en-latn", "e", "de-DE-x", "en_US", None, "sr-Cyrl-XK"]
    bad = [p is not None for p in values(spark, checks.hreflang_problem, rows)]
    assert bad == [False, False, False, True, True, True, True, False, True, True, True, True, True]


def test_addresses_dates_and_ranges(spark):
    rows = ["8.8.8.8", "10.1.2.3", "172.31.0.1", "172.32.0.1", "::1", "::", "fe80::1", "fd00::2", "2001:db8::1", "::ffff:10.0.0.1", "::ffff:9.9.9.9", "256.1.1.1", "x", "1:2", None]
    assert values(spark, urls.is_public_address, rows) == [True, False, False, True, False, False, False, False, True, False, True, False, False, False, False]
    iso = values(spark, times.read_iso_date, ["2026-02-28", "2026-02-30", "2026-10-03T10:00:00,5+05", "2026-10-03t10:00z", "2026-10-03T25:00", "October 3", None])
    assert [None if x is None else (x.epoch_ms, x.has_time, x.has_zone) for x in iso] == [(1772236800000, False, False), None, (1791003600500, True, True), (1791021600000, True, True), None, None, None]
    assert values(spark, times.instant_of, ["October 3, 2026", "2026-02-30", "nonsense"]) == [1790985600000, None, None]
    assert values(spark, times.is_time_zone, ["Europe/Kyiv", "Not/AZone", "", None, "../etc/passwd"]) == [True, False, False, False, False]


def test_listing_and_sources(spark):
    links = ["https://www.s.test/blog/a?x=1", "https://s.test/blog/a/", "https://s.test/blog/tag/x", "https://s.test/blog/", "https://s.test/about", "https://o.test/blog/b", "https://s.test/blog/2024/c#z"]
    df = spark.createDataFrame([(1, "https://s.test/blog", links)], "page_id long, url string, links array<string>")
    assert [(r.place, r.link) for r in discovery.listing_links(df, ["page_id"], "url", "links").orderBy("place").collect()] == [(0, "https://www.s.test/blog/a"), (6, "https://s.test/blog/2024/c")]
    record = html.parse('<link rel="alternate" type="application/rss+xml" href="/feed"><link rel=alternate type="text/html" href="/x"><div style="background:url(/i.png)"><p>x</p></div><meta property="og:image" content="/i.png"><meta property="article:tag" content="t">', "https://a.test/p")
    assert (record["feeds"], record["share_image"], record["share_image_as_background"], record["declared_keywords"]) == (["https://a.test/feed"], "https://a.test/i.png", True, ["t"])


def test_posts(spark):
    article = '<script type="application/ld+json">{"@type":"BlogPosting"}</script>'
    long = "<p>" + "word " * 200 + "</p>"
    pages = [
        ("https://s.test/a", 200, "text/html", True, article + long, "crawled"), ("https://o.test/a", 200, "text/html", True, long, "skipped_other_site"), ("https://s.test/", 200, "text/html", True, long, "skipped_listing"),
        ("https://s.test/f.pdf", 200, "text/html", True, long, "skipped_not_html"), ("https://s.test/r", 200, "text/html", False, long, "skipped_robots"), ("https://s.test/g", 404, "text/html", True, long, "failed"),
        ("https://s.test/j", 200, "application/json", True, long, "skipped_not_html"), ("https://s.test/l", 200, "", True, '<script type="application/ld+json">{"@type":"ItemList"}</script>' + long, "skipped_listing"),
        ("https://s.test/n", 200, "text/html", True, long, "skipped_listing"), ("https://s.test/s", 200, "text/html", True, article + "<h1>Page not found</h1><p>few words</p>", "failed"), ("https://s.test/t", 200, "text/html", True, article + "<p>few words here</p>", "skipped_listing"),
    ]
    df = spark.createDataFrame([(k, "s.test", u, u, s, c, a, True, h) for k, (u, s, c, a, h, _) in enumerate(pages)], "place long, site string, url string, final_url string, http_status int, content_type string, allowed boolean, articles_only boolean, html string")
    got = {r.place: r.status for r in posts.select_posts(html.parse_pages(df), "site", "place").collect()}
    assert got == {k: p[-1] for k, p in enumerate(pages)}
    many = spark.range(40).selectExpr("id AS place", "'s.test' AS site", "concat('https://s.test/', id) AS url", "concat('https://s.test/', id) AS final_url", "IF(id % 2 = 0, 200, 500) AS http_status", "'text/html' AS content_type", "true AS allowed", "false AS articles_only", f"'{long}' AS html")
    taken = posts.select_posts(html.parse_pages(many), "site", "place").collect()
    assert len(taken) == 29 and sum(r.status == "crawled" for r in taken) == 15


def test_pacing(spark):
    df = spark.createDataFrame([("k", k, t) for k, t in enumerate((0.0, 0.1, 0.2, 5.0, 5.5))], "key string, n long, at double")
    assert [r.sent for r in pacing.paced(df, "key", "at", ["n"]).orderBy("n").collect()] == [0.0, 1.0, 2.0, 5.0, 6.0]
    seeds = spark.createDataFrame([(k * 7919,) for k in range(50)], "n long")
    assert all(abs(r.v - next(ranks.draws(r.n))) < 1e-12 for r in seeds.select("n", ranks.mulberry32(F.col("n")).alias("v")).collect())


def test_dev_hosts(spark):
    rows = ["https://staging.site.example/", "https://dev.example/", "https://x.vercel.app/a", "http://localhost:3000/", "http://a.local/", "http://10.0.0.1/", "http://[::1]/", "https://www.site.example/", "https://test.page.example/", None, "x"]
    dev = lambda u: urls.is_dev_host(u, F.lit("https://test.page.example/p"))
    assert values(spark, dev, rows) == [True, False, True, True, True, True, True, False, False, False, False]
