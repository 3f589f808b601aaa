"""Speed and site queries on answers made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteglass.functions import urls
from siteglass.operators import site_checks, speed
from siteglass.plans import model as m
from siteglass.plans.registry import query
from siteglass.sources import discovery
from siteglass.streaming import captures


def answers(spark, sf_dir):
    """One measuring answer a supplier: field LCP and CLS, lab LCP, a performance score."""
    s = m.table(spark, sf_dir, "supplier")
    lcp, cls = F.abs("s_acctbal"), (F.col("s_suppkey") % 40).cast("double")
    body = F.format_string(
        '{"loadingExperience":{"metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":%.2f},"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":%.0f,"distributions":[{"min":0,"max":10}]}}},'
        '"lighthouseResult":{"audits":{"is-crawlable":{"score":%s,"scoreDisplayMode":"binary"}},"categories":{"performance":{"score":%.2f}}}}',
        lcp, cls, F.when(F.col("s_suppkey") % 3 == 0, "0").otherwise("1"), (F.col("s_suppkey") % 100) / 100.0,
    )
    status = F.when(F.col("s_suppkey") % 10 == 0, 429).when(F.col("s_suppkey") % 10 == 1, 503).otherwise(200)
    return speed.parsed(s.select("s_suppkey", status.alias("status"), F.when(status == 200, body).otherwise(F.lit("{}")).alias("body")))


@query("psi_classify", "SELECT s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN 'rateLimited' WHEN 1 THEN 'transient' ELSE 'measured' END AS outcome FROM supplier", prelude=False)
def psi_classify(spark, sf_dir):
    return answers(spark, sf_dir).select("s_suppkey", speed.classify(F.col("status")).alias("outcome"))


_OK = "s_suppkey % 10 > 1"


@query("psi_measure", f"SELECT s_suppkey, round(abs(s_acctbal), 2) AS lcp, round((s_suppkey % 40) / 100::DOUBLE, 4) AS cls, CAST(s_suppkey % 100 AS INTEGER) AS score FROM supplier WHERE {_OK}", prelude=False)
def psi_measure(spark, sf_dir):
    out = speed.measure(answers(spark, sf_dir).where("status = 200")).where("measured")
    return out.select("s_suppkey", F.col("lcp.value").alias("lcp"), F.col("cls.value").alias("cls"), "score")


@query("cwv_issues", f"SELECT s_suppkey, 'lcp' AS metric, CASE WHEN abs(s_acctbal) <= 4000 THEN 'needsImprovement' ELSE 'poor' END AS band FROM supplier WHERE {_OK} AND abs(s_acctbal) > 2500 UNION ALL SELECT s_suppkey, 'cls', CASE WHEN s_suppkey % 40 <= 25 THEN 'needsImprovement' ELSE 'poor' END FROM supplier WHERE {_OK} AND s_suppkey % 40 > 10", prelude=False)
def cwv_issues(spark, sf_dir):
    return speed.vital_issues(speed.measure(answers(spark, sf_dir).where("status = 200")), "s_suppkey").select("s_suppkey", "metric", "band")


@query("speed_summary", f"SELECT s_suppkey, CASE WHEN abs(s_acctbal) <= 2500 THEN 'good' WHEN abs(s_acctbal) <= 4000 THEN 'needsImprovement' ELSE 'poor' END AS lcp_band, 'url' AS lcp_source FROM supplier WHERE {_OK}", prelude=False)
def speed_summary(spark, sf_dir):
    return speed.measure(answers(spark, sf_dir).where("status = 200")).select("s_suppkey", F.col("lcp.band").alias("lcp_band"), F.col("lcp.source").alias("lcp_source"))


@query("lh_extract", f"SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'is-crawlable' ELSE '' END AS failed FROM supplier WHERE {_OK}", prelude=False)
def lh_extract(spark, sf_dir):
    return speed.measure(answers(spark, sf_dir).where("status = 200")).select("s_suppkey", F.array_join("lighthouse_failed", ",").alias("failed"))


#: Robots files of three kinds of sites; the third names rules that are not supported, and a group that drops one.
_ROBOTS = (None, "User-agent: *\nDisallow: /admin", "User-agent: *\nDisallow: /admin\nUser-agent: Googlebot\nNoindex: /x")


def sites(spark, sf_dir):
    """Each site of the pages with what a crawl would know of it, made from the length of its name so that every
    answer of every check occurs."""
    p = m.table(spark, sf_dir, "pages").select("url", urls.site_key(F.col("url")).alias("site"))
    n = F.length("site")
    one = p.groupBy("site").agg(F.count(F.lit(1)).alias("pages")).withColumn("n", n)
    origin = F.concat(F.lit("https://"), "site")
    probe = F.struct(F.lit("http://other").alias("url"), F.when(n % 2 == 0, 200).otherwise(301).alias("status"), (n % 4).alias("hops"), F.when(n % 5 == 0, 302).otherwise(301).alias("first_status"), F.lit("http://other").alias("origin"))
    icon = F.struct(F.lit("png").alias("format"), F.lit(16).alias("width"), F.when(n % 2 == 0, 16).otherwise(15).alias("height"), F.lit(200).alias("status"), F.lit(False).alias("blocked"))
    known = one.select(
        "site", "pages", "n", origin.alias("served_origin"), F.when(n % 3 == 1, _ROBOTS[1]).when(n % 3 == 2, _ROBOTS[2]).alias("robots"), F.when(n % 3 > 0, F.when(n % 4 == 0, 600_000).otherwise(60)).alias("robots_bytes"),
        F.when(n % 3 > 0, F.array(probe)).alias("probes"), F.when(n % 3 > 0, F.when(n % 2 == 0, 200).otherwise(404)).alias("made_up_status"), F.when(n % 5 > 0, icon).alias("icon"),
        F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit("The Site"))).when(n % 4 == 2, F.array(F.lit("Other"))).alias("site_names"), F.lit("the  site!").alias("og_site_name"),
        (n % 2).cast("int").alias("client_rendered"), F.lit("2024-01-02").cast("timestamp").alias("crawled_at"),
    )
    status = F.when(F.length("url") % 7 == 0, 301).otherwise(200)
    lastmod = F.when(F.length("site") % 2 == 0, F.lit("2024-01-01")).otherwise(F.concat(F.lit("2023-0"), (F.length("url") % 9 + 1).cast("string"), F.lit("-01")))
    entries = p.select("site", "url", status.alias("status"), F.col("url").alias("final_url"), F.lit(False).alias("noindex"), F.lit(False).alias("blocked"), lastmod.alias("lastmod"))
    return site_checks.sitemap_counts(entries, known, "site")


def _outcome(code: str, severity: str, applies: str, fails: str) -> str:
    return f"SELECT site, '{code}' AS code, '{severity}' AS severity, CASE WHEN NOT ({applies}) THEN 'notApplicable' WHEN {fails} THEN 'failed' ELSE 'passed' END AS status FROM s"


_SITE_SQL = f"""WITH p AS (SELECT url, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS site FROM pages),
s AS (SELECT site, length(site) AS n, count(*) AS pages, count(*) FILTER (length(url) % 7 = 0) AS bad, count(*) FILTER (lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) <> 'https://' || site) AS others,
 count(DISTINCT CASE WHEN length(site) % 2 = 0 THEN 0 ELSE length(url) % 9 + 1 END) AS kinds FROM p GROUP BY site)
""" + " UNION ALL ".join(_outcome(*x) for x in (
    ("ROBOTS_TXT_TRUNCATED", "warning", "n % 3 > 0", "n % 4 = 0"), ("ROBOTS_TXT_UNSUPPORTED_RULES", "notice", "n % 3 > 0", "n % 3 = 2"), ("ROBOTS_GOOGLEBOT_GROUP_DROPS_RULES", "warning", "n % 3 = 2", "true"),
    ("SITEMAP_LISTS_NON_INDEXABLE", "warning", "true", "bad > 0"), ("SITEMAP_LISTS_OTHER_HOST_VARIANTS", "warning", "true", "others > 0"), ("SITEMAP_LASTMOD_UNRELIABLE", "notice", "pages >= 5", "kinds = 1"),
    ("HOST_VARIANT_SERVES_CONTENT", "warning", "n % 3 > 0", "n % 2 = 0 AND n % 4 = 0"), ("HOST_REDIRECT_CHAIN", "notice", "n % 3 > 0", "n % 4 = 3 OR n % 5 = 0"), ("SOFT_404", "warning", "n % 3 > 0", "n % 2 = 0"),
    ("FAVICON_INVALID", "warning", "n % 5 > 0", "n % 2 = 1"), ("SITE_NAME_NOT_DECLARED", "notice", "n % 4 < 3", "n % 4 = 0"), ("SITE_NAME_INCONSISTENT", "notice", "n % 4 IN (1, 2)", "n % 4 = 2"), ("CONTENT_NEEDS_JAVASCRIPT", "notice", "true", "n % 2 = 1"),
))


@query("site_checks", _SITE_SQL, prelude=False)
def all_site_checks(spark, sf_dir):
    return site_checks.evaluate(sites(spark, sf_dir), "site")


def _site_query(code: str) -> None:
    @query(f"site_{code.lower()}", f"SELECT site, status FROM ({_SITE_SQL}) WHERE code = '{code}'", prelude=False)
    def run(spark, sf_dir):
        return all_site_checks(spark, sf_dir).where(F.col("code") == code).select("site", "status")


for _code in (
    "ROBOTS_TXT_TRUNCATED", "ROBOTS_TXT_UNSUPPORTED_RULES", "ROBOTS_GOOGLEBOT_GROUP_DROPS_RULES", "SITEMAP_LISTS_NON_INDEXABLE", "SITEMAP_LISTS_OTHER_HOST_VARIANTS", "SITEMAP_LASTMOD_UNRELIABLE",
    "HOST_VARIANT_SERVES_CONTENT", "HOST_REDIRECT_CHAIN", "SOFT_404", "FAVICON_INVALID", "SITE_NAME_NOT_DECLARED", "SITE_NAME_INCONSISTENT", "CONTENT_NEEDS_JAVASCRIPT",
):
    _site_query(_code)


@query("src_sitemap_txt", "SELECT page_id, 1 AS urls FROM pages", prelude=False)
def src_sitemap_txt(spark, sf_dir):
    p = m.table(spark, sf_dir, "pages").select("page_id", "url")
    found = discovery.read_documents(p, discovery.read_sitemap, "url", "map", "struct<kind:string,urls:array<string>,lastmods:array<string>,news:int>")
    return found.select("page_id", F.size("map.urls").alias("urls"))


@query("src_sitemap_xml", "SELECT page_id, 'urlset' AS kind FROM pages", prelude=False)
def src_sitemap_xml(spark, sf_dir):
    xml = F.concat(F.lit("<urlset><url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>"))
    p = m.table(spark, sf_dir, "pages").select("page_id", xml.alias("xml"))
    found = discovery.read_documents(p, discovery.read_sitemap, "xml", "map", "struct<kind:string,urls:array<string>,lastmods:array<string>,news:int>")
    return found.select("page_id", "map.kind")


@query("src_feed")
def src_feed(spark, sf_dir):
    rss = F.concat(F.lit("<rss><channel><item><link>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</link></item></channel></rss>"))
    p = m.table(spark, sf_dir, "pages").select("page_id", rss.alias("xml"))
    return discovery.read_documents(p, discovery.read_feed, "xml", "links", "array<string>")


@query("st_daily_latest", "SELECT page_no, keyword, CAST(captured_at AS DATE) AS day, arg_max(position, (captured_at, snapshot_id)) AS position, count(*) AS points FROM snaps GROUP BY ALL")
def st_daily_latest(spark, sf_dir):
    """The batch reference of the streaming captures."""
    return captures.daily_latest(captures.positions(m.table(spark, sf_dir, "events")))
