"""Queries over parsed pages: the record, its parts, and every check of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteglass.functions import urls
from siteglass.operators import checks, posts
from siteglass.plans import model as m
from siteglass.plans.registry import query
from siteglass.sources import discovery, html


def parsed(spark, sf_dir):
    """The crawled pages; a run is all pages of one site."""
    found = html.parse_pages(m.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("site", urls.site_key(F.col("url")))


@query("parse_page")
def parse_page(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "site", "page.*")


@query("main_content")
def main_content(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "page.word_count", "page.content_hash", "page.first_paragraph")


@query("text_blocks")
def text_blocks(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.posexplode("page.blocks").alias("pos", "block"))


@query("links_extract")
def links_extract(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.explode("page.links").alias("link"))


@query("src_html", "SELECT page_id, strlen(html) AS html_bytes FROM pages WHERE strlen(html) <= 5242880", prelude=False)
def src_html(spark, sf_dir):
    return m.table(spark, sf_dir, "pages").where(F.octet_length("html") <= html.MOST_BYTES).select("page_id", F.octet_length("html").alias("html_bytes"))


#: What a crawl would know of a page beside its HTML, made from its number so that every answer occurs: a robots file
#: a site, statuses, headers, the crawl before.
ROBOTS = "User-agent: *\\nDisallow: /de/\\nAllow: /de/1\\n\\nUser-agent: GPTBot\\nDisallow: /\\n\\nUser-agent: Googlebot\\nDisallow: /fr/"


def crawled(spark, sf_dir):
    """parsed pages with the facts that checks ask for."""
    from siteglass.operators import facts

    p = parsed(spark, sf_dir).withColumn("n", F.col("page_id"))
    seen = p.withColumns(
        {
            "final_url": F.col("url"), "fetched_at": F.lit("2024-06-01").cast("timestamp"), "year": F.lit(2024), "content_type": F.when(F.col("n") % 4 == 0, "text/html").otherwise("text/html; charset=utf-8"),
            "content_encoding": F.when(F.col("n") % 5 != 0, "gzip"), "cache_control": F.when(F.col("n") % 7 == 0, "private, no-store").otherwise("max-age=60"), "redirected": F.col("n") % 6 == 0,
            "preview_width": F.when(F.col("n") % 3 > 0, (F.col("n") % 3 * 800).cast("int")), "robots": F.lit(ROBOTS.replace("\\n", "\n")),
        }
    )
    before = p.select("page_id", F.when(F.col("n") % 2 == 0, F.col("page.content_hash")).otherwise("other").alias("previous_hash"), F.lit("2020-01-01").alias("previous_modified"))
    answers = p.select(F.explode(F.array_distinct("page.links")).alias("link")).distinct().withColumn("status", F.when(F.length("link") % 9 == 0, 404).when(F.length("link") % 9 == 1, 301).otherwise(200))
    return facts.gathered(seen, before, answers)


def _fact_query(code: str, sql: str | None = None) -> None:
    @query(f"fact_{code.lower()}", sql, prelude=False)
    def run(spark, sf_dir):
        return checks.evaluate(crawled(spark, sf_dir), "site", (code,)).select("page_id", "outcome")


_URL_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_FACT_SQL = {
    "ROBOTS_BLOCKS_GOOGLEBOT": f"CASE WHEN starts_with({_URL_PATH}, '/fr/') THEN 'fails' ELSE 'pass' END",
    "ROBOTS_BLOCKS_AI_SEARCH": f"CASE WHEN starts_with({_URL_PATH}, '/de/') AND NOT starts_with({_URL_PATH}, '/de/1') THEN 'fails' ELSE 'pass' END",
    "REDIRECTED": "CASE WHEN page_id % 6 = 0 THEN 'fails' ELSE 'pass' END",
    "HTML_NOT_COMPRESSED": "CASE WHEN page_id % 5 = 0 THEN 'fails' ELSE 'pass' END",
    "PREVIEW_IMAGE_TOO_SMALL": "CASE page_id % 3 WHEN 0 THEN 'notApplicable' WHEN 1 THEN 'fails' ELSE 'pass' END",
    "BFCACHE_BLOCKED_BY_NO_STORE": "CASE WHEN page_id % 7 = 0 THEN 'fails' ELSE 'pass' END",
}
for _code in (
    "ROBOTS_BLOCKS_GOOGLEBOT", "ROBOTS_BLOCKS_RESOURCES", "ROBOTS_BLOCKS_AI_SEARCH", "TITLE_YEAR_OUTDATED", "CANONICAL_TARGET_BROKEN", "DATE_BUMPED_WITHOUT_CHANGES", "BROKEN_LINKS", "LINKS_TO_REDIRECTS",
    "HREFLANG_NOT_RECIPROCAL", "PREVIEW_IMAGE_TOO_SMALL", "REDIRECTED", "HTML_NOT_COMPRESSED", "KEYWORD_CANNIBALISATION", "BFCACHE_BLOCKED_BY_NO_STORE",
):
    _fact_query(_code, f"SELECT page_id, CASE WHEN strlen(html) > {html.MOST_BYTES} THEN 'notApplicable' ELSE {_FACT_SQL[_code]} END AS outcome FROM pages" if _code in _FACT_SQL else None)


def _record_query(name: str, column, sql: str | None = None) -> None:
    @query(name, sql, prelude=False)
    def run(spark, sf_dir):
        return parsed(spark, sf_dir).select("page_id", column().alias(name))


_record_query("canonicals", lambda: F.array_union("page.canonicals", "page.canonicals_outside_head"))
_record_query("alternates", lambda: F.transform("page.alternates", lambda a: a["href"]))
_record_query("open_graph", lambda: F.array_sort(F.map_keys("page.open_graph")))
_record_query("resources_extract", lambda: F.col("page.resource_urls"))
_record_query("client_rendered", lambda: F.col("page.client_rendered"), "SELECT page_id, false AS client_rendered FROM pages")
_record_query("featured_image", lambda: F.col("page.featured_loading"))
_record_query("share_image", lambda: F.col("page.share_image"))
_record_query("shown_as_background", lambda: F.col("page.share_image_as_background"), "SELECT page_id, false AS shown_as_background FROM pages")
_record_query("authors_markup", lambda: F.col("page.authors"))
_record_query("hidden_text_removal", lambda: F.array_join("page.blocks", "\n"))
_record_query("src_alt_feeds", lambda: F.col("page.feeds"))
_record_query("is_article", posts.is_article, "SELECT page_id, regexp_matches(html, '\"@type\": ?\"(Article|BlogPosting|NewsArticle|TechArticle|Report)\"|content=\"article\"') AS is_article FROM pages")
_record_query("is_listing", posts.is_listing, "SELECT page_id, regexp_matches(html, '\"@type\": ?\"(CollectionPage|ItemList)\"') AS is_listing FROM pages")
_record_query("soft_404", posts.is_soft_404)
_record_query("thin", posts.is_thin)
_record_query("fn_hreflang_problem", lambda: F.transform("page.alternates", lambda a: checks.hreflang_problem(a["lang"])))


def read_html(spark, sf_dir, name, column, reader, schema):
    """One reader over a document made for each page."""
    made = m.table(spark, sf_dir, "pages").select("page_id", column.alias("text"))
    return discovery.read_documents(made, reader, "text", name, schema)


def _reader_query(name: str, column, reader, schema: str, sql: str | None = None) -> None:
    @query(name, sql, prelude=False)
    def run(spark, sf_dir):
        return read_html(spark, sf_dir, "value", column(), reader, schema)


_ID = "cast(page_id AS string)"
_SRCSET = lambda: F.concat(F.col("url"), F.lit(" 1x, /b,c.jpg 2x,"), F.lit("d"), F.expr(_ID), F.lit(".jpg 3x"))
_LD = lambda: F.concat(
    F.lit('{"@graph":[{"@type":"BlogPosting","headline":"h'), F.expr(_ID), F.lit('","image":[{"@id":"#i"},"/b.png"],"author":[{"@id":"#a"},{"name":"Bo"}],"keywords":"x, y"},{"@id":"#a","@type":"Person","name":"Ann'), F.expr(_ID),
    F.lit('"},{"@id":"#i","@type":"ImageObject","contentUrl":"https://a.test/i.png"},{"@type":"Organization","logo":{"url":"https://a.test/l.png"}},{"@type":"WebSite","name":"Site'), F.expr(_ID),
    F.lit('"},{"@type":"BreadcrumbList","itemListElement":[{"position":1,"name":"Home","item":"https://a.test/"},{"position":"2","item":{"@id":"https://a.test/x","name":"X"}}]}]}'),
)


def _ld_page(text):
    return html.parse(f'<html><head><script type="application/ld+json">{text}</script></head><body><div itemscope itemtype="https://schema.org/Article"><h1 itemprop="headline">h</h1></div></body></html>', "https://a.test/p")


_reader_query("fn_srcset_urls", _SRCSET, lambda t: " ".join(html.srcset_urls(t)), "string", "SELECT page_id, url || ' /b,c.jpg d' || page_id || '.jpg' AS value FROM pages")
_reader_query("fn_absolute_url", lambda: F.regexp_replace("url", "^https?:", ""), lambda u: html.absolute(u, "https://a.test/p"), "string", "SELECT page_id, regexp_replace(url, '^https?:', 'https:') AS value FROM pages")
_reader_query("fn_parse_json_ld", _LD, lambda t: " ".join(sorted(html.read_json_ld(t))), "string", "SELECT page_id, '@graph' AS value FROM pages")
_reader_query("fn_json_ld_graph", _LD, lambda t: sum(1 for _ in html.ld_nodes(html.read_json_ld(t))), "int", "SELECT page_id, CAST(7 AS INTEGER) AS value FROM pages")
_reader_query("fn_authors_of", _LD, lambda t: ", ".join(_ld_page(t)["authors"]), "string", "SELECT page_id, 'Ann' || page_id || ', Bo' AS value FROM pages")
_reader_query("fn_images_of", _LD, lambda t: " ".join(_ld_page(t)["article_images"]), "string", "SELECT page_id, 'https://a.test/i.png https://a.test/b.png' AS value FROM pages")
_reader_query("fn_breadcrumb_items", _LD, lambda t: " ".join(f"{x['position']}:{x['name']}:{x['item']}" for x in _ld_page(t)["breadcrumbs"]), "string", "SELECT page_id, '1:Home:https://a.test/ 2:X:https://a.test/x' AS value FROM pages")
_reader_query("fn_website_name", _LD, lambda t: " ".join(_ld_page(t)["website_names"]), "string", "SELECT page_id, 'Site' || page_id AS value FROM pages")
_reader_query("fn_logos_of", _LD, lambda t: " ".join(_ld_page(t)["logos"]), "string", "SELECT page_id, 'https://a.test/l.png' AS value FROM pages")
_reader_query("fn_microdata", _LD, lambda t: " ".join(_ld_page(t)["microdata_types"]), "string", "SELECT page_id, 'Article' AS value FROM pages")


def _check_query(code: str, sql: str | None = None) -> None:
    @query(f"check_{code.lower()}", sql, prelude=False)
    def run(spark, sf_dir):
        return checks.evaluate(parsed(spark, sf_dir).select("page_id", "url", "site", "page"), "site", (code,)).select("page_id", "outcome")


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_PLAIN = {
    "TITLE_MISSING": f"CASE WHEN trim({_TITLE}) = '' THEN 'fails' ELSE 'pass' END",
    "META_DESCRIPTION_MISSING": "CASE WHEN regexp_matches(html, '<meta[^>]*name=\"description\"') THEN 'pass' ELSE 'fails' END",
    "H1_MISSING": "CASE WHEN regexp_matches(html, '<h1>[^<]+') THEN 'pass' ELSE 'fails' END",
    "CANONICAL_MISSING": "CASE WHEN regexp_matches(html, 'rel=\"canonical\"') THEN 'pass' ELSE 'fails' END",
    "LANG_MISSING": "CASE WHEN regexp_matches(html, '<html[^>]* lang=\"[^\"]+\"') THEN 'pass' ELSE 'fails' END",
    "VIEWPORT_MISSING": "CASE WHEN regexp_matches(html, 'name=\"viewport\"') THEN 'pass' ELSE 'fails' END",
    "NOT_HTTPS": "CASE WHEN starts_with(url, 'http:') THEN 'fails' ELSE 'pass' END",
    "LARGE_PAGE": "CASE WHEN strlen(html) > 1048576 THEN 'fails' ELSE 'pass' END",
    "IMAGES_MISSING_ALT": "CASE WHEN NOT regexp_matches(html, '<img') THEN 'notApplicable' WHEN regexp_matches(html, '<img[^>]*alt=') THEN 'pass' ELSE 'fails' END",
    "NOINDEX": "CASE WHEN regexp_matches(html, '<meta[^>]*robots[^>]*noindex') THEN 'fails' ELSE 'pass' END",
    "BREADCRUMB_MISSING": "CASE WHEN regexp_matches(html, 'BreadcrumbList') THEN 'pass' ELSE 'fails' END",
    "AUTHOR_MISSING": "CASE WHEN regexp_matches(html, 'name=\"author\"|rel=\"author\"') THEN 'pass' ELSE 'fails' END",
}
for _x in checks.CATALOGUE:
    _check_query(_x.code, f"SELECT page_id, CASE WHEN strlen(html) > {html.MOST_BYTES} THEN 'notApplicable' ELSE {_PLAIN[_x.code]} END AS outcome FROM pages" if _x.code in _PLAIN else None)


@query("src_listing")
def src_listing(spark, sf_dir):
    """Each page as a listing: the pages below it that it links to."""
    p = parsed(spark, sf_dir).withColumn("links", F.col("page.links"))
    return discovery.listing_links(p.select("page_id", "url", "links"), ["page_id"], "url", "links")


@query("select_posts")
def select_posts(spark, sf_dir):
    """The pages of a site as the candidates of its run."""
    p = parsed(spark, sf_dir).withColumns({"final_url": F.col("url"), "http_status": F.when(F.col("page_id") % 11 == 0, 404).otherwise(200), "content_type": F.lit("text/html"), "allowed": F.col("page_id") % 13 != 0, "articles_only": F.lit(False)})
    return posts.select_posts(p, "site", "page_id").select("site", "page_id", "status", "reason")
