"""Checks of a whole site, as columns over one row a site.

Input columns, each nullable: robots (text), robots_bytes, sitemap (the counts of `sitemap_counts`), served_origin, probes (array<struct<url, status, hops, first_status,
origin>>), made_up_status, icon (struct<format, width, height, status, blocked>), site_names, og_site_name,
client_rendered, pages, crawled_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.functions import texts


def _origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z]+://[^/?#]+)", 1))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(x))


#: Seconds around the crawl in which a lastmod says no more than when the sitemap was made.
NEAR = 7200
SITEMAP = "struct<urls:long,non_indexable:long,other_hosts:long,lastmods:long,distinct_lastmods:long,near_lastmods:long>"


def sitemap_counts(entries: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """sites (key, served_origin, crawled_at, ...) with `sitemap`, counts over the entries (key, url, status,
    final_url, noindex, blocked, lastmod) of each site's sitemaps: no list of a site's URLs is ever made."""
    own = entries.join(sites.select(key, "served_origin", "crawled_at"), key)
    at = F.coalesce(F.try_to_timestamp("lastmod"), F.try_to_timestamp("lastmod", F.lit("yyyy-MM-dd")))
    own = own.withColumn("__at", at)
    bad = (F.col("status") >= 300) | F.col("noindex") | F.col("blocked") | (F.col("final_url") != F.col("url"))
    near = F.abs(F.unix_timestamp("__at") - F.unix_timestamp("crawled_at")) <= NEAR
    counted = own.groupBy(key).agg(
        F.struct(
            F.count(F.lit(1)).alias("urls"), F.count_if(bad).alias("non_indexable"), F.count_if(_origin(F.col("url")) != F.col("served_origin")).alias("other_hosts"), F.count("__at").alias("lastmods"),
            F.countDistinct("__at").alias("distinct_lastmods"), F.count_if(near).alias("near_lastmods"),
        ).alias("sitemap")
    )
    return sites.join(counted, key, "left")


def _unreliable() -> Column:
    return (F.col("sitemap.distinct_lastmods") == 1) | (F.col("sitemap.near_lastmods") >= 0.8 * F.col("sitemap.lastmods"))


def rules() -> dict[str, tuple[str, Column, Column]]:
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    host_probes = F.filter("probes", lambda p: p["origin"] != F.col("served_origin"))
    return {
        "ROBOTS_TXT_TRUNCATED": ("warning", F.col("robots_bytes").isNotNull(), F.col("robots_bytes") > 500 * 1024),
        "ROBOTS_TXT_UNSUPPORTED_RULES": ("notice", F.col("robots").isNotNull(), F.exists(_lines(F.col("robots")), lambda x: x.rlike("^(noindex|nofollow|host)\\s*:"))),
        "ROBOTS_GOOGLEBOT_GROUP_DROPS_RULES": ("warning", F.lower("robots").rlike("user-agent\\s*:\\s*googlebot"), F.lower("robots").rlike("(?s)user-agent\\s*:\\s*\\*[^u]*disallow\\s*:\\s*/") & ~F.lower("robots").rlike("(?s)user-agent\\s*:\\s*googlebot\\s*\\n(?:(?!user-agent).)*disallow\\s*:\\s*/")),
        "SITEMAP_LISTS_NON_INDEXABLE": ("warning", F.col("sitemap.urls") > 0, F.col("sitemap.non_indexable") > 0),
        "SITEMAP_LISTS_OTHER_HOST_VARIANTS": ("warning", (F.col("sitemap.urls") > 0) & F.col("served_origin").isNotNull(), F.col("sitemap.other_hosts") > 0),
        "SITEMAP_LASTMOD_UNRELIABLE": ("notice", F.col("sitemap.lastmods") >= 5, _unreliable()),
        "HOST_VARIANT_SERVES_CONTENT": ("warning", some("probes"), F.exists(host_probes, lambda p: (p["status"].between(200, 299)) & (p["hops"] == 0))),
        "HOST_REDIRECT_CHAIN": ("notice", some("probes"), F.exists("probes", lambda p: (p["hops"] >= 3) | p["first_status"].isin(302, 303, 307))),
        "SOFT_404": ("warning", F.col("made_up_status").isNotNull(), F.col("made_up_status").between(200, 299)),
        "FAVICON_INVALID": ("warning", F.col("icon").isNotNull(), F.col("icon.blocked") | (F.col("icon.status") >= 400) | F.col("icon.format").isNull() | (F.col("icon.width") != F.col("icon.height")) | (F.col("icon.width") < 8)),
        "SITE_NAME_NOT_DECLARED": ("notice", F.col("site_names").isNotNull(), F.size("site_names") == 0),
        "SITE_NAME_INCONSISTENT": ("notice", some("site_names") & F.col("og_site_name").isNotNull(), ~F.exists("site_names", lambda n: texts.normalised(n) == texts.normalised(F.col("og_site_name")))),
        "CONTENT_NEEDS_JAVASCRIPT": ("notice", F.col("pages") > 0, F.col("client_rendered") > 0),
    }


def evaluate(sites: DataFrame, key: str) -> DataFrame:
    """A row for each site and check: key, code, severity, status (passed, failed, notApplicable)."""
    rows = [
        F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.when(~F.coalesce(applies, F.lit(False)), "notApplicable").when(F.coalesce(fails, F.lit(False)), "failed").otherwise("passed").alias("status"))
        for code, (severity, applies, fails) in rules().items()
    ]
    return sites.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")
