"""The page record, the checks and what sites publish, on hand-made pages."""

import datetime as dt

from siteglass.operators import checks, keywords, ranks, site_checks, speed, writes
from siteglass.plans.relational import escape_like, page_slice_of
from siteglass.sources import discovery, html
from siteglass.streaming import captures

GOOD = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>How to prune an old apple tree in early spring</title>
<meta name="description" content="A short guide to pruning old apple trees in spring, with the tools you need and the cuts that help the tree most of all.">
<meta name="viewport" content="width=device-width"><link rel="canonical" href="https://www.site.test/prune"><meta name="robots" content="max-image-preview:large">
<meta property="og:title" content="x"><meta property="og:description" content="y"><meta property="og:image" content="https://site.test/a.png">
<script type="application/ld+json">{"@graph":[{"@type":"BlogPosting","headline":"Prune an old apple tree","datePublished":"2024-01-02T10:00:00Z","dateModified":"2024-01-03","image":"i.png","author":{"@id":"#a"}},
{"@id":"#a","@type":"Person","name":"Ann Green"},{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Home","item":"https://site.test/"}]}]}</script></head>
<body><nav><a href="/">Home</a></nav><main><h1>Prune an old apple tree</h1><p>Old trees need care &amp; patience.<br>Start small. <a href="https://other.test/source">A source</a> and <a href="/next">next</a></p><h2>Tools</h2><p>A saw.
<img src="/img/saw.jpg" alt="a saw"></main><footer>Old furniture text that does not count</footer></body></html>"""
BAD = "<html><body><h1>A</h1><h3>B</h3><a href='javascript:x()'>go</a><img src='DSC_0001.jpg'><p>tiny <b>text"


def frame(spark, pages):
    df = spark.createDataFrame([(k, "site.test", u, h) for k, (u, h) in enumerate(pages)], "page_id long, site string, url string, html string")
    return html.parse_pages(df)


def test_record():
    r = html.parse(GOOD, "https://site.test/prune")
    assert r["title"].startswith("How to prune") and r["lang"] == "en" and r["h1s"] == ["Prune an old apple tree"]
    assert r["canonicals"] == ["https://www.site.test/prune"] and r["authors"] == ["Ann Green"] and r["article_fields"] == list(html.ARTICLE_FIELDS)
    assert r["blocks"][0] == "Old trees need care & patience. Start small. A source and next" and not any("furniture" in b for b in r["blocks"])
    assert r["breadcrumbs"] == [{"position": 1, "name": "Home", "item": "https://site.test/"}] and r["date_published"] == "2024-01-02T10:00:00Z"
    assert [h["level"] for h in r["headings"]] == [1, 2] and r["links"][1:] == ["https://other.test/source", "https://site.test/next"]
    empty = html.parse(None, None)
    assert empty["title"] is None and empty["blocks"] == [] and empty["word_count"] == 0
    assert html.srcset_urls("a.jpg 1x, b.jpg 2x,c.jpg") == ["a.jpg", "b.jpg", "c.jpg"]
    assert html.count_words("two words - 日本") == 4


def test_checks(spark):
    df = frame(spark, [("https://site.test/prune", GOOD), ("http://site.test/bad", BAD), ("https://site.test/copy", GOOD), ("https://site.test/none", None)])
    rows = checks.evaluate(df, "site").collect()
    got = {(r.page_id, r.code): r.outcome for r in rows}
    assert len(rows) == 4 * len(checks.CATALOGUE) and len(checks.BY_CODE) == 74
    for code in ("TITLE_MISSING", "TITLE_LENGTH", "META_DESCRIPTION_MISSING", "H1_MISSING", "LANG_MISSING", "VIEWPORT_MISSING", "NOT_HTTPS", "STRUCTURED_DATA_MISSING", "STRUCTURED_DATA_INCOMPLETE", "BREADCRUMB_INVALID", "AUTHOR_MISSING", "IMAGES_MISSING_ALT", "OG_TAGS_MISSING", "NO_INTERNAL_LINKS"):
        assert got[0, code] == "pass", code
    for code in ("TITLE_MISSING", "META_DESCRIPTION_MISSING", "HEADING_SKIP", "CANONICAL_MISSING", "LANG_MISSING", "VIEWPORT_MISSING", "NOT_HTTPS", "IMAGES_MISSING_ALT", "IMAGE_FILENAMES_GENERIC", "UNCRAWLABLE_LINKS", "THIN_CONTENT", "AUTHOR_MISSING", "STRUCTURED_DATA_MISSING"):
        assert got[1, code] == "fails", code
    for code in ("TITLE_LENGTH", "CANONICAL_MISMATCH", "ROBOTS_BLOCKS_GOOGLEBOT", "BROKEN_LINKS", "MIXED_CONTENT", "HREFLANG_INVALID"):
        assert got[1, code] == "notApplicable", code
    assert got[0, "TITLE_DUPLICATE"] == "fails" and got[1, "TITLE_DUPLICATE"] == "notApplicable"
    score = {r.page_id: r for r in checks.summary(checks.evaluate(df, "site"), "site").collect()}
    assert score[0].score > score[1].score and set(score[0].judged).isdisjoint(score[0].not_applicable)


def test_run_of_one_and_near_duplicates(spark):
    words = " ".join(f"w{k}" for k in range(200))
    other = words.replace("w150", "changed")
    df = spark.createDataFrame([(1, "a", words), (2, "a", other), (3, "b", words), (4, "a", "short"), (5, "a", "z " * 300)], "page_id long, run string, text string")
    got = {r.page_id: (r.n_shingles, r.near_pages) for r in checks.near_duplicates(df).collect()}
    assert got == {1: (196, 1), 2: (196, 1), 3: (196, None), 4: (0, None), 5: (1, None)}


def test_site_checks(spark):
    from siteglass.plans import speed as plans

    schema = "site string, sitemap struct<urls:long,non_indexable:long,other_hosts:long,lastmods:long,distinct_lastmods:long,near_lastmods:long>, pages long, served_origin string, robots string, robots_bytes int, probes array<struct<url:string,status:int,hops:int,first_status:int,origin:string>>, made_up_status int, icon struct<format:string,width:int,height:int,status:int,blocked:boolean>, site_names array<string>, og_site_name string, client_rendered int, crawled_at timestamp"
    row = ("s", (6, 0, 0, 6, 1, 0), 3, "https://s.test", "user-agent: *\nnoindex: /", 700_000, [("http://s.test", 200, 0, 200, "http://s.test")], 200, ("png", 16, 15, 200, False), ["The S"], "Other", 1, dt.datetime(2024, 2, 1))
    bad = {r.code: r.status for r in site_checks.evaluate(spark.createDataFrame([row], schema), "site").collect()}
    assert len(bad) == 13 and {k for k, v in bad.items() if v == "failed"} == set(bad) - {"ROBOTS_GOOGLEBOT_GROUP_DROPS_RULES", "SITEMAP_LISTS_NON_INDEXABLE", "SITEMAP_LISTS_OTHER_HOST_VARIANTS", "HOST_REDIRECT_CHAIN", "SITE_NAME_NOT_DECLARED"}
    empty = spark.createDataFrame([("s", *[None] * 12)], schema)
    assert {r.status for r in site_checks.evaluate(empty, "site").collect()} == {"notApplicable"}
    entries = [("s", f"https://{h}s.test/{k}", 200, f"https://{h}s.test/{k}", k == 2, False, "2024-02-01T00:30:00Z" if k else None) for k, h in enumerate(("", "", "", "www."))]
    e = spark.createDataFrame(entries, "site string, url string, status int, final_url string, noindex boolean, blocked boolean, lastmod string")
    both = spark.createDataFrame([("s", "https://s.test", dt.datetime(2024, 2, 1)), ("t", None, None)], "site string, served_origin string, crawled_at timestamp")
    got = {r.site: r.sitemap for r in site_checks.sitemap_counts(e, both, "site").collect()}
    assert tuple(got["s"]) == (4, 1, 1, 3, 1, 3) and got["t"] is None
    assert plans.sites is not None


def test_documents():
    assert discovery.read_sitemap("https://a.test/x\nhttps://a.test/y\n")["urls"] == ["https://a.test/x", "https://a.test/y"]
    assert discovery.read_sitemap("https://a.test/x\nnot a url")["kind"] == "invalid" and discovery.read_sitemap(None)["kind"] == "invalid"
    assert discovery.read_sitemap("<sitemapindex><sitemap><loc> https://a.test/s.xml </loc></sitemap></sitemapindex>")["kind"] == "index"
    assert discovery.inflate(discovery.compress("hello")) == b"hello" and discovery.inflate(b"\x1f\x8bjunk") is None
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="alternate" href="https://a.test/p?utm_source=x&amp;id=1#c"/></entry></feed>'
    assert discovery.read_feed(atom) == ["https://a.test/p?id=1"]
    assert discovery.read_feed('{"items": [{"url": "https://a.test/j"}]}') == ["https://a.test/j"] and discovery.read_feed("junk") == []
    robots = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: Googlebot\nDisallow: /g\nSitemap: https://a.test/s.xml"
    allows = lambda agent, path: discovery.robots_allows(robots, agent, f"https://a.test{path}")
    assert not allows("Other", "/private/x") and allows("Other", "/private/open/y") and not allows("Other", "/f.pdf") and allows("Googlebot", "/private/x") and not allows("Googlebot", "/g/1")
    assert discovery.read_robots(robots)[1] == ["https://a.test/s.xml"]
    assert discovery.image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4) + (480).to_bytes(4)) == ("png", 640, 480) and discovery.image_size(b"junk") is None
    found = discovery.read_incidents('[{"service_name":"Ranking","external_desc":"May 2024 core update","begin":"2024-05-01"},{"service_name":"Ranking","begin":null},{"service_name":"Other","begin":"x"}]')
    assert [x["kind"] for x in found] == ["core"]
    assert discovery.group_score("blog-sitemap", ["https://a.test/blog/1"], set()) > discovery.group_score("tag-sitemap", ["https://a.test/tag/1"], set())
    assert escape_like("50%_\\") == "50\\%\\_\\\\" and page_slice_of(0, 500) == (0, 50) and page_slice_of(3, 20) == (40, 20)


def test_speed_answers(spark):
    origin = '{"loadingExperience":{"origin_fallback":true,"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":3000}}},"lighthouseResult":{"audits":{"cumulative-layout-shift":{"numericValue":0.3}},"categories":{"performance":{"score":0.905}}}}'
    df = speed.parsed(spark.createDataFrame([(1, 200, origin), (2, 200, "{}"), (3, 400, '{"error":{"errors":[{"reason":"keyInvalid"}]}}'), (4, 500, "junk"), (5, 200, None)], "id long, status int, body string"))
    kinds = {r.id: r.k for r in df.select("id", speed.classify(df.status).alias("k")).collect()}
    assert kinds == {1: "measured", 2: "permanent", 3: "keyRejected", 4: "transient", 5: "permanent"}
    r = speed.measure(df).where("id = 1").first()
    assert (r.lcp.value, r.lcp.source, r.lcp.band, r.cls.source, r.cls.band, r.inp, r.score, r.measured) == (3000.0, "origin", "needsImprovement", "lab", "poor", None, 91, True)
    assert sorted(x.metric for x in speed.vital_issues(speed.measure(df).where("id = 1"), "id").collect()) == ["cls", "lcp"]


def test_writes(spark, tmp_path):
    from pyspark.sql import functions as F

    jobs = spark.createDataFrame([(1, "running", 1, dt.datetime(2024, 1, 1)), (2, "running", 5, dt.datetime(2024, 1, 1)), (3, "running", 2, dt.datetime(2024, 1, 1)), (4, "queued", 0, dt.datetime(2024, 1, 1))], "run_id long, status string, attempts int, next_at timestamp")
    results = spark.createDataFrame([(1, 1, True), (2, 5, False), (3, 1, False)], "run_id long, attempt int, ok boolean")
    after = {r.run_id: r for r in writes.settle(jobs, results, F.lit("2024-01-02").cast("timestamp")).collect()}
    assert [after[k].status for k in (1, 2, 3, 4)] == ["done", "failed", "running", "queued"]
    assert not writes.is_final(spark, f"file://{tmp_path}/run")
    writes.finalize({"jobs": jobs}, f"file://{tmp_path}/run")
    assert writes.is_final(spark, f"file://{tmp_path}/run")


def test_keywords_and_walk(spark):
    rows = [("apple tree", 10.0, False, [1]), ("apple", 9.0, True, [2]), ("pear", 8.0, False, [3]), ("saw", 5.0, True, [4]), ("Oslo", 4.0, True, [1]), ("long way", 3.5, False, [1]), ("old mill", 3.0, False, [1]), ("noise here", 1.0, False, [])]
    assert keywords.choose(rows, 5) == [("apple tree", 1.0), ("saw", 0.5), ("long way", 0.35)] and len(keywords.choose(rows, 1)) == 1
    a, b, c = lambda d: d, lambda d: d, lambda d: d
    assert keywords.insert_after([a, b], a, c) == [a, c, b] and keywords.without([a, b], a) == [b] and keywords.replace_step([a, b], b, c) == [a, c] and keywords.insert_before([a], a, b) == [b, a]
    rows = [("r", 1, "en", "title", "Pruning apple trees"), ("r", 1, "en", "body", "Pruning apple trees is easy. Apple trees like it."), ("r", 2, "en", "title", "Baking bread"), ("r", 2, "en", "body", "Bread needs time."), ("r", 3, "en", "body", "")]
    df = spark.createDataFrame(rows, "run string, page_id long, lang string, field string, text string")
    words = spark.createDataFrame([(1, 500), (2, 100), (3, 0)], "page_id long, words int")
    got = {r.page_id: r.term for r in keywords.keywords(df, words).collect() if r.relevance == 1.0}
    assert got[1] == "pruning apple trees" and got[2] == "baking bread" and 3 not in got
    # a page of single words alone, which are no names, has no keyword
    few = spark.createDataFrame([("r", 4, "en", "title", "Bread"), ("r", 4, "en", "body", "bread, bread")], "run string, page_id long, lang string, field string, text string")
    assert keywords.keywords(few, spark.createDataFrame([(4, 10)], "page_id long, words int")).count() == 0
    assert ranks.seed("", "") == (ranks.FNV_OFFSET * ranks.FNV_PRIME) & 0xFFFFFFFF
    whole = ranks.walk("u", "t", 0.5, 20_000, 60)
    first = ranks.walk("u", "t", 0.5, 20_000, 25)
    assert first + ranks.walk("u", "t", 0.5, 20_025, 35, first[-1]) == whole and all(1 <= x <= 100 for x in whole)
    assert all(3 <= ranks.home(1, k * 7919) <= 15 and 63 <= ranks.home(0.2, k * 7919) <= 77 for k in range(500))


def test_stream_equals_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [(k, dt.datetime(2024, 1, 1 + k % 6, k % 24), k % 3, "view", float(k % 90), "{}") for k in range(120)]
    late = [(999, dt.datetime(2024, 3, 1), 1, "view", 5.0, "{}")]
    spark.createDataFrame(rows + rows[:10], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    captures.stream(spark, f"{tmp_path}/in/*", f"{tmp_path}/check", f"{tmp_path}/out").awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    batch = captures.daily_latest(captures.positions(spark.createDataFrame(rows, schema)))
    assert got == sorted(map(tuple, batch.collect()))
