"""Which candidates of a crawl are posts: a status and a reason for each, in order, up to a number of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteglass.functions import texts, urls

#: The longest URL, the words of the shortest post, candidates looked at and posts taken of a run.
MOST_URL, LEAST_WORDS, MOST_CANDIDATES, MOST_POSTS = 2048, 120, 30, 15
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle", "TechArticle", "Report")
LISTING_TYPES = ("CollectionPage", "ItemList")
OTHER_FILES = (
    "pdf", "jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico", "zip", "gz", "xml", "rss", "json", "csv", "txt", "mp4", "mp3", "mov", "avi", "webm", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
)
#: Fixed values, as patterns: headings that announce a missing page.
_NOT_FOUND = "(?i)" + "|".join((
    "^(error\\s*)?404\\b", "^(oops[!.,]?\\s*)?(the\\s+)?page\\s+(was\\s+)?not\\s+found", "^nothing\\s+(was\\s+)?found", "(can['’]?t|cannot)\\s+be\\s+found", "^page\\s+(does\\s+not|doesn['’]?t)\\s+exist", "^not\\s+found$",
))


def _overlap(array: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, values))), F.lit(False))


def is_article(page: str = "page") -> Column:
    """What a page says of itself: by Open Graph or by its structured data."""
    return F.coalesce(F.lower(F.col(f"{page}.open_graph")["og:type"]) == "article", F.lit(False)) | _overlap(F.col(f"{page}.json_ld_types"), ARTICLE_TYPES)


def is_listing(page: str = "page") -> Column:
    return _overlap(F.col(f"{page}.json_ld_types"), LISTING_TYPES)


def is_soft_404(page: str = "page") -> Column:
    """A short page whose heading or title says that there is nothing, whatever its status."""
    heads = F.array_compact(F.array(F.get(F.col(f"{page}.h1s"), F.lit(0)), F.get(texts.title_segments(F.col(f"{page}.title")), F.lit(0))))
    says = F.exists(heads, lambda h: (F.length(h) <= 60) & F.trim(h).rlike(_NOT_FOUND))
    return says & (F.col(f"{page}.word_count") < 3 * LEAST_WORDS)


def is_thin(page: str = "page") -> Column:
    return F.col(f"{page}.word_count") < LEAST_WORDS


def examined(candidates: DataFrame) -> DataFrame:
    """candidates (url, site, final_url, http_status, content_type, allowed, articles_only, page) with status and
    reason; the first rule that a candidate breaks decides."""
    path, extension = urls.path(F.col("url")), urls.extension(F.col("url"))
    kind = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    rules = [
        (F.length("url") > MOST_URL, "failed", F.lit(f"URL longer than {MOST_URL} characters")),
        (urls.site_key(F.col("url")) != F.col("site"), "skipped_other_site", F.lit("Belongs to another site")),
        (path.isin("", "/"), "skipped_listing", F.lit("The site's home page")),
        (extension.isin(*OTHER_FILES), "skipped_not_html", F.concat(F.lit("Not an HTML page (."), extension, F.lit(")"))),
        (~F.col("allowed"), "skipped_robots", F.lit("Disallowed by robots.txt")),
        (F.col("http_status").isNull(), "failed", F.lit("No answer")),
        (urls.site_key(F.col("final_url")) != F.col("site"), "skipped_other_site", F.lit("Redirected to another site")),
        (F.col("http_status") >= 300, "failed", F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))),
        ((kind != "") & ~kind.isin("text/html", "application/xhtml+xml"), "skipped_not_html", F.concat(F.lit("Not HTML ("), kind, F.lit(")"))),
        (F.col("page").isNull(), "failed", F.lit("Not readable")),
        (is_listing(), "skipped_listing", F.lit("Declares itself a listing")),
        (F.col("articles_only") & ~is_article(), "skipped_listing", F.lit("Not marked as an article")),
        (is_soft_404(), "failed", F.lit("Soft 404")),
        (is_thin() & F.col("page.client_rendered"), "skipped_listing", F.lit("Rendered by JavaScript")),
        (is_thin(), "skipped_listing", F.lit("Too little content to analyse")),
    ]
    status, reason = F.lit("crawled"), F.lit(None).cast("string")
    for test, name, why in reversed(rules):
        broken = F.coalesce(test, F.lit(False))
        status, reason = F.when(broken, name).otherwise(status), F.when(broken, why).otherwise(reason)
    return candidates.withColumns({"status": status, "reason": reason})


def select_posts(candidates: DataFrame, run: str, place: str) -> DataFrame:
    """The candidates that a run looks at, in order: among the first MOST_CANDIDATES, until MOST_POSTS are taken."""
    own = W.partitionBy(run).orderBy(place)
    seen = examined(candidates.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= MOST_CANDIDATES))
    taken = F.sum((F.col("status") == "crawled").cast("int")).over(own.rowsBetween(W.unboundedPreceding, -1))
    return seen.withColumn("__taken", F.coalesce(taken, F.lit(0))).where(F.col("__taken") < MOST_POSTS).drop("__n", "__taken")
