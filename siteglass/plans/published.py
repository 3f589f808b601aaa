"""Queries over what sites publish, and over calls in time, on documents made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteglass.functions import texts, urls
from siteglass.operators import keywords, pacing, speed, writes
from siteglass.plans import model as m
from siteglass.plans.registry import query
from siteglass.plans.relational import escape_like
from siteglass.sources import discovery

_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _pages(spark, sf_dir):
    return m.table(spark, sf_dir, "pages").select("page_id", "url")


ROBOTS = "User-agent: *\\nDisallow: /de/\\nAllow: /de/1\\n# end\\nUser-agent: OtherBot\\nDisallow: /\\nSitemap: https://a.test/s.xml".replace("\\n", "\n")


def _verdict(url):
    allowed, line = discovery.robots_rule(ROBOTS, "SomeBot", url)
    return {"allowed": allowed, "line": line}


def _robots(text):
    groups, sitemaps = discovery.read_robots(text)
    return {"groups": len(groups), "rules": sum(len(rules) for _, rules in groups), "sitemaps": sitemaps}


@query("robots_match", f"SELECT page_id, NOT (starts_with({_PATH}, '/de/') AND NOT starts_with({_PATH}, '/de/1')) AS allowed, CASE WHEN starts_with({_PATH}, '/de/1') THEN 3 WHEN starts_with({_PATH}, '/de/') THEN 2 END::INTEGER AS line FROM pages", prelude=False)
def robots_match(spark, sf_dir):
    """Whether a page may be read, and the line of the rule that says so."""
    found = discovery.read_documents(_pages(spark, sf_dir), _verdict, "url", "v", "struct<allowed:boolean,line:int>")
    return found.select("page_id", "v.allowed", "v.line")


@query("src_robots", "SELECT page_id, CAST(2 AS INTEGER) AS groups, CAST(2 + page_id % 3 AS INTEGER) AS rules, 'https://a.test/' || page_id || '.xml' AS sitemap FROM pages", prelude=False)
def src_robots(spark, sf_dir):
    text = F.concat(F.lit("User-agent: a\nUser-agent: b\nDisallow: /x\nDisallow:\n"), F.repeat(F.lit("Allow: /y # more\n"), (F.col("page_id") % 3).cast("int")), F.lit("User-agent: *\nDisallow: /z\nSitemap: https://a.test/"), F.col("page_id").cast("string"), F.lit(".xml"))
    made = _pages(spark, sf_dir).select("page_id", text.alias("text"))
    found = discovery.read_documents(made, _robots, "text", "v", "struct<groups:int,rules:int,sitemaps:array<string>>")
    return found.select("page_id", "v.groups", "v.rules", F.get("v.sitemaps", F.lit(0)).alias("sitemap"))


def _from_gzip(url):
    return (discovery.inflate(discovery.compress(url)) or b"").decode()


@query("src_sitemap_gz", "SELECT page_id, url AS text FROM pages", prelude=False)
def src_sitemap_gz(spark, sf_dir):
    """Documents packed by gzip, recognised by their first bytes, come out as they were."""
    return discovery.read_documents(_pages(spark, sf_dir), _from_gzip, "url", "text", "string")


@query("src_incidents_json", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'core' WHEN page_id % 3 = 1 THEN 'spam' ELSE 'other' END AS kind, '2024-05-01' AS begin_day FROM pages", prelude=False)
def src_incidents_json(spark, sf_dir):
    title = F.when(F.col("page_id") % 3 == 0, "May core update").when(F.col("page_id") % 3 == 1, "June spam update").otherwise("Something else")
    text = F.concat(F.lit('[{"service_name":"Ranking","external_desc":"'), title, F.lit('","begin":"2024-05-01"},{"service_name":"Other","begin":"2024-06-01"},{"service_name":"Ranking","begin":null}]'))
    made = _pages(spark, sf_dir).select("page_id", text.alias("text"))
    found = discovery.read_documents(made, discovery.read_incidents, "text", "v", "array<struct<kind:string,begin:string>>")
    return found.select("page_id", F.explode("v").alias("x")).select("page_id", "x.kind", F.col("x.begin").alias("begin_day"))


def _png_size(number):
    head = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (int(number) + 1).to_bytes(4) + (2 * int(number) + 3).to_bytes(4)
    kind, width, height = discovery.image_size(head)
    return {"format": kind, "width": width, "height": height}


@query("src_image_header", "SELECT page_id, 'png' AS format, CAST(page_id + 1 AS INTEGER) AS width, CAST(2 * page_id + 3 AS INTEGER) AS height FROM pages", prelude=False)
def src_image_header(spark, sf_dir):
    made = _pages(spark, sf_dir).select("page_id", F.col("page_id").cast("string").alias("number"))
    return discovery.read_documents(made, _png_size, "number", "v", "struct<format:string,width:int,height:int>").select("page_id", "v.*")


#: Sitemap groups of a site: its pages by the first segment of their path; the score is that of a name and a share.
_GROUPS = f"SELECT {_HOST} AS site, regexp_extract({_PATH}, '^/([^/]*)', 1) AS name, count(*) AS urls, CAST(length(regexp_extract({_PATH}, '^/([^/]*)', 1)) - CASE WHEN regexp_extract({_PATH}, '^/([^/]*)', 1) = 'de' THEN 5 ELSE 0 END AS DOUBLE) AS score, min(page_id) AS place FROM pages GROUP BY ALL"


def _groups(spark, sf_dir):
    p = _pages(spark, sf_dir).select(urls.site_key(F.col("url")).alias("site"), F.coalesce(F.get(urls.segments(F.col("url")), F.lit(0)), F.lit("")).alias("name"), "page_id")
    found = p.groupBy("site", "name").agg(F.count(F.lit(1)).alias("urls"), F.min("page_id").alias("place"))
    return found.withColumn("score", (F.length("name") - F.when(F.col("name") == "de", 5).otherwise(0)).cast("double"))


@query("topk_group_winner", f"SELECT site, name, score, urls, score >= 2 AS confirmed FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, urls DESC, place) AS n FROM ({_GROUPS})) WHERE n = 1 AND score >= 0", prelude=False)
def topk_group_winner(spark, sf_dir):
    return discovery.group_winner(_groups(spark, sf_dir), "site")


def _score(text):
    name, _, listed = text.partition("\n")
    found = listed.split("\n")
    return discovery.group_score(name, found, set(found[:1]))


@query("score_sitemap_group", "SELECT page_id, CAST(CASE page_id % 3 WHEN 0 THEN 3 WHEN 1 THEN -3 ELSE 2 END + 3 * CASE WHEN page_id % 2 = 0 THEN 1.0 ELSE 0.5 END + 4 * 0.5 AS DOUBLE) AS score FROM pages", prelude=False)
def score_sitemap_group(spark, sf_dir):
    """Names, paths and overlap with the feed: of two URLs one is in the feed, one or both are below /blog/."""
    name = F.when(F.col("page_id") % 3 == 0, "blog-sitemap").when(F.col("page_id") % 3 == 1, "tag-sitemap").otherwise("news")
    second = F.when(F.col("page_id") % 2 == 0, "https://a.test/blog/2").otherwise("https://a.test/shop/2")
    made = _pages(spark, sf_dir).select("page_id", F.concat_ws("\n", name, F.lit("https://a.test/blog/1"), second).alias("text"))
    return discovery.read_documents(made, _score, "text", "score", "double")


@query("discover_blog", f"SELECT site, CASE WHEN n % 4 = 0 THEN 'sitemap' WHEN n % 4 = 1 THEN 'feed' WHEN n % 4 = 2 THEN 'listing' ELSE 'unconfirmed-sitemap' END AS source, n % 4 = 2 AS articles_only FROM (SELECT {_HOST} AS site, count(*) AS n FROM pages GROUP BY ALL)", prelude=False)
def discover_blog(spark, sf_dir):
    """Of what each site offers, the surest source of posts."""
    sites = _pages(spark, sf_dir).groupBy(urls.site_key(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n"))
    kind = F.col("n") % 4
    offers = F.array(
        F.struct(F.lit("sitemap").alias("source"), (kind == 0).alias("confirmed"), F.array(F.lit("s")).alias("urls")), F.struct(F.lit("feed").alias("source"), F.lit(False).alias("confirmed"), F.when(kind <= 1, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")).alias("urls")),
        F.struct(F.lit("listing").alias("source"), F.lit(False).alias("confirmed"), F.when(kind <= 2, F.array(F.lit("l"))).otherwise(F.array().cast("array<string>")).alias("urls")),
    )
    return discovery.blog_sources(sites.select("site", F.explode(offers).alias("o")).select("site", "o.*"), "site").select("site", "source", "articles_only")


def answers(spark, sf_dir):
    """An answer a supplier with twelve images, the phases of its largest paint, shares of visits and diagnostics."""
    image = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.format_string('{"url":"https://a.test/%02d.png","totalBytes":%d,"wastedBytes":%d}', k, k * 1000, (k * 7 + F.col("s_suppkey")) % 13 * 100))
    body = F.concat(
        F.lit('{"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":1,"distributions":[{"proportion":0.5},{"proportion":0.25},{"proportion":0.25}]}}},"lighthouseResult":{"audits":{"image-delivery-insight":{"details":{"items":['),
        F.array_join(image, ","), F.lit(']}},"unused-javascript":{"score":'), F.when(F.col("s_suppkey") % 2 == 0, "0").otherwise("1"), F.lit('},"dom-size-insight":{"score":0.5},'),
        F.lit('"lcp-breakdown-insight":{"details":{"items":[{"items":[{"subpart":"elementRenderDelay","duration":-3},{"subpart":"timeToFirstByte","duration":'), F.col("s_suppkey").cast("string"), F.lit('.5}]},{"type":"node","selector":"img.hero","snippet":"<img>"}]}}}}}'),
    )
    return speed.parsed(m.table(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body")))


_WASTED = "SELECT s_suppkey, k, (k * 7 + s_suppkey) % 13 * 100 AS wasted FROM supplier, range(1, 13) r(k)"


@query("topk_images", f"SELECT s_suppkey, n AS place, printf('https://a.test/%02d.png', k) AS url, CAST(wasted AS DOUBLE) AS wasted_bytes FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY wasted DESC, k) - 1 AS INTEGER) AS n FROM ({_WASTED}) WHERE wasted > 0) WHERE n < 10", prelude=False)
def topk_images(spark, sf_dir):
    """The ten images that waste the most."""
    rows = answers(spark, sf_dir).select("s_suppkey", F.posexplode(speed.heaviest_images()).alias("place", "x"))
    return rows.select("s_suppkey", "place", "x.url", "x.wasted_bytes")


@query("img_delivery", f"SELECT s_suppkey, CAST(count(*) AS INTEGER) AS images, CAST(sum(wasted) AS DOUBLE) AS wasted FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY wasted DESC, k) AS n FROM ({_WASTED}) WHERE wasted > 0) WHERE n <= 10 GROUP BY s_suppkey", prelude=False)
def img_delivery(spark, sf_dir):
    images = answers(spark, sf_dir).withColumn("x", speed.heaviest_images())
    return images.select("s_suppkey", F.size("x").alias("images"), F.aggregate("x", F.lit(0.0), lambda a, i: a + i["wasted_bytes"]).alias("wasted"))


@query("fn_lcp_breakdown", "SELECT s_suppkey, 'img.hero' AS selector, 'timeToFirstByte=' || (s_suppkey + 1) || ',elementRenderDelay=0' AS phases FROM supplier", prelude=False)
def fn_lcp_breakdown(spark, sf_dir):
    x = answers(spark, sf_dir).withColumn("x", speed.lcp_breakdown())
    return x.select("s_suppkey", "x.selector", F.array_join(F.transform("x.phases", lambda p: F.concat(p["phase"], F.lit("="), p["ms"].cast("string"))), ",").alias("phases"))


@query("fn_visit_shares", "SELECT s_suppkey, CAST(0.5 AS DOUBLE) AS good, CAST(0.25 AS DOUBLE) AS poor FROM supplier", prelude=False)
def fn_visit_shares(spark, sf_dir):
    return answers(spark, sf_dir).select("s_suppkey", speed.visit_shares("lcp").alias("x")).select("s_suppkey", "x.*")


@query("psi_diagnostics", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'unused-javascript,' ELSE '' END || 'dom-size-insight' AS failed FROM supplier", prelude=False)
def psi_diagnostics(spark, sf_dir):
    return answers(spark, sf_dir).select("s_suppkey", F.array_join(speed.diagnostics(), ",").alias("failed"))


@query("src_psi_json", "SELECT s_suppkey, CAST(12 AS INTEGER) AS images, CAST(4 AS INTEGER) AS audits FROM supplier", prelude=False)
def src_psi_json(spark, sf_dir):
    audits = F.col("a.lighthouseResult.audits")
    return answers(spark, sf_dir).select("s_suppkey", F.size(audits["image-delivery-insight"]["details"]["items"]).alias("images"), F.size(audits).alias("audits"))


@query("speed_findings_by_owner", f"SELECT * FROM (VALUES ('crawl', CAST(74 AS BIGINT)), ('lighthouse', CAST({len(speed.SEO_AUDITS)} AS BIGINT)), ('vitals', CAST({len(speed.METRICS)} AS BIGINT))) v(owner, codes)", prelude=False)
def speed_findings_by_owner(spark, sf_dir):
    """Each code has one owner: codes of several would be counted more than once."""
    rows = spark.createDataFrame(speed.owners(), "code string, owner string")
    one = rows.groupBy("code").agg(F.collect_set("owner").alias("owners")).where(F.size("owners") == 1)
    return one.groupBy(F.get("owners", F.lit(0)).alias("owner")).agg(F.count(F.lit(1)).alias("codes"))


@query("lh_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', 'LIGHTHOUSE_{k.replace('-', '_').upper()}')" for k in speed.SEO_AUDITS) + ") v(audit, code)", prelude=False)
def lh_catalogue(spark, sf_dir):
    return spark.createDataFrame([(k, f"LIGHTHOUSE_{k.replace('-', '_').upper()}") for k in speed.SEO_AUDITS], "audit string, code string")


_CALLS = "SELECT event_id, user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS asked FROM events"


def _calls(spark, sf_dir):
    return m.table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("asked"))


@query("rate_limit", f"SELECT event_id, max(asked - n) OVER (PARTITION BY user_id ORDER BY asked, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + n AS sent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY asked, event_id) - 1 AS n FROM ({_CALLS}))", prelude=False)
def rate_limit(spark, sf_dir):
    """When each call of a key is sent, at least a unit of time after the one before it."""
    return pacing.paced(_calls(spark, sf_dir), "user_id", "asked", ["event_id"], 1).select("event_id", "sent")


@query("st_cache", f"SELECT event_id, answer, answer IS NOT NULL AS available FROM (SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY asked, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS answer FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id END AS value FROM ({_CALLS})))", prelude=False)
def st_cache(spark, sf_dir):
    """The latest answer that was read, kept through failures."""
    fetched = _calls(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("event_id")))
    return pacing.cached(fetched, "user_id", "asked", ["event_id"], "value").select("event_id", "answer", "available")


@query("st_wakeup", f"SELECT event_id, max(CASE WHEN event_id % 50 = 0 THEN asked + 24 END) OVER w AS paused_until, coalesce(bool_or(event_id % 997 = 0) OVER w, false) AS halted FROM ({_CALLS}) WINDOW w AS (PARTITION BY user_id ORDER BY asked, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", prelude=False)
def st_wakeup(spark, sf_dir):
    """What holds the next call back: the longest pause that answers before it asked for, or a refused key."""
    pause, halted = F.when(F.col("event_id") % 50 == 0, 24), F.col("event_id") % 997 == 0
    return pacing.held_until(_calls(spark, sf_dir), "user_id", "asked", ["event_id"], pause, halted).select("event_id", "paused_until", "halted")


@query("fn_decode_xml", "SELECT p_partkey, p_name || ' & \"' || p_brand || '\" <A>' AS value FROM part", prelude=False)
def fn_decode_xml(spark, sf_dir):
    """Entities of a document's text, named and by number, read back."""
    text = F.concat(F.lit("<urlset><url><loc>"), "p_name", F.lit(" &amp; &quot;"), "p_brand", F.lit("&#34; &lt;&#x41;&gt;</loc></url></urlset>"))
    made = m.table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return discovery.read_documents(made, lambda t: discovery.read_sitemap(t)["urls"][0], "text", "value", "string")


@query("fn_escape_like", "SELECT p_partkey, replace(replace(replace(p_type || '_50%', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS value FROM part", prelude=False)
def fn_escape_like(spark, sf_dir):
    made = m.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit("_50%")).alias("text"))
    return discovery.read_documents(made, escape_like, "text", "value", "string")


@query("fn_slug_of", f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(string_split({_PATH}, '/')[-1], '[.][A-Za-z0-9]+$', ''), '-[0-9]+x[0-9]+$', ''), '[-_]', ' ', 'g') AS value FROM pages", prelude=False)
def fn_slug_of(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", texts.slug(urls.stem(F.col("url"))).alias("value"))


@query("win_greedy_select")
def win_greedy_select(spark, sf_dir):
    """Terms of a brand by price until its budget is used; each term is a part's name."""
    p = m.table(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), (F.col("p_size") % 5).cast("long").alias("page_id"), F.col("p_name").alias("term"), F.col("p_retailprice").cast("double").alias("score"), F.lit(900).alias("words"), (F.col("p_size") % 2 == 0).alias("proper"), F.array(F.col("p_size").cast("long")).alias("sources"))
    return keywords.select(p)


@query("st_queue_crawl", "SELECT event_id AS run_id, CASE WHEN event_id % 4 = 3 THEN 'queued' WHEN event_id % 4 = 0 THEN 'done' WHEN event_id % 8 = 1 THEN 'failed' WHEN event_id % 4 = 1 THEN 'queued' ELSE 'running' END AS status FROM events", prelude=False)
def st_queue_crawl(spark, sf_dir):
    """Jobs after their results: done, tried again, given up after the last attempt, or left to a later attempt."""
    n = F.col("event_id") % 4
    e = m.table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.when(n == 3, "queued").otherwise("running").alias("status"), F.when(F.col("event_id") % 8 == 1, 5).otherwise(2).alias("attempts"), F.col("ts").alias("next_at"), n.alias("n"))
    results = e.where("n < 3").select("run_id", F.when(F.col("n") == 2, 1).otherwise(F.col("attempts")).alias("attempt"), (F.col("n") == 0).alias("ok"))
    return writes.settle(e.drop("n"), results, F.lit("2024-06-01").cast("timestamp")).select("run_id", "status")
