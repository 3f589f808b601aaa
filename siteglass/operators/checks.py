"""The check catalogue: three-valued rules over parsed pages, weighed by severity.

A rule gives `fails` (boolean) and `applies` (boolean); the outcome is notApplicable where `applies` is
false or unknown or the page has no record, else fail or pass. Page rules are columns over one row. Run
rules need counts over the other pages of a run, which are aggregated from narrow columns and joined, and
only where a chosen rule asks for them. Facts from outside the HTML (robots
verdicts, link answers, headers, the crawl before) are nullable columns: a null fact makes the rule that
asks for it not applicable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteglass.functions import texts, times, urls
from siteglass.sources.scratch import written

#: Facts that a crawl adds to a page, by type.
FACTS = {
    "final_url": "string", "fetched_at": "timestamp", "year": "int", "content_type": "string", "cache_control": "string", "content_encoding": "string", "x_robots": "array<string>",
    "redirected": "boolean", "allows_googlebot": "boolean", "allows_ai": "array<boolean>", "blocked_resources": "array<string>", "link_status": "map<string,int>", "link_first_hop": "map<string,int>",
    "canonical_status": "int", "alternates_back": "array<boolean>", "preview_width": "int", "preview_is_logo": "boolean", "previous_hash": "string", "previous_modified": "string",
    "top_keyword": "string", "og_usable": "boolean",
}
SHORT_TEXT, NEAR, LEAST_SHINGLES = 300, 0.6, 50
ARTICLE_FIELDS = ("headline", "image", "datePublished", "dateModified", "author")
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle", "TechArticle", "Report")
_ISO = "^\\d{4}-\\d{2}(-\\d{2}(T\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?)?)?$"


def p(name: str) -> Column:
    return F.col(f"page.{name}")


def c(name: str) -> Column:
    return F.col(name)


def some(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) > 0


def _rules(*names: str) -> Column:
    return F.arrays_overlap(F.concat(p("meta_robots"), p("meta_googlebot"), F.coalesce(c("x_robots"), F.array().cast("array<string>"))), F.array(*map(F.lit, names)))


def _unavailable() -> Column:
    """An unavailable_after rule whose date has passed when the page was fetched."""
    said = F.filter(F.concat(p("meta_robots"), p("meta_googlebot")), lambda r: r.startswith("unavailable_after:"))
    dates = F.transform(said, lambda r: times.instant_of(F.upper(F.trim(F.substring_index(r, "unavailable_after:", -1)))))
    return F.coalesce(F.exists(dates, lambda d: d < F.unix_millis(c("fetched_at"))), F.lit(False))


def _directive(prefix: str) -> Column:
    return F.exists(F.concat(p("meta_robots"), p("meta_googlebot")), lambda r: r.startswith(prefix))


def _internal() -> Column:
    return F.filter(p("links"), lambda u: urls.is_same_site(u, c("final_url")) & ~urls.is_same_document(u, c("final_url")))


def _canonical() -> Column:
    return F.get(p("canonicals"), 0)


def _elsewhere() -> Column:
    return F.coalesce(urls.document(_canonical()) != urls.document(c("final_url")), F.lit(False))


def _long() -> Column:
    return p("word_count") >= SHORT_TEXT


def _resources() -> Column:
    return p("resource_urls")


@dataclass(frozen=True)
class Check:
    code: str
    severity: str
    fails: Callable[[], Column]
    applies: Callable[[], Column] = lambda: F.lit(True)


def _stem_generic(u: Column) -> Column:
    return F.lower(urls.stem(u)).rlike("^(img|image|dsc|dscn|photo|picture|screenshot|untitled|pic|p)?[-_ ]?\\(?[0-9]*\\)?$|^(placeholder|default|image|img|photo|unnamed)$")


def _title_words() -> Column:
    return F.array_distinct(F.split(texts.normalised(F.concat_ws(" ", p("title"), F.array_join(p("h1s"), " "))), " "))


def _published() -> Column:
    return F.coalesce(F.try_to_timestamp(p("date_published")), F.try_to_timestamp(p("date_published"), F.lit("yyyy-MM-dd")))


def _modified() -> Column:
    return F.coalesce(F.try_to_timestamp(p("date_modified")), F.try_to_timestamp(p("date_modified"), F.lit("yyyy-MM-dd")))


def _bad_links(status: str, test) -> Column:
    return F.exists(F.map_values(c(status)), test)


def _script_letters(text: Column, script: str) -> Column:
    return F.regexp_count(text, F.lit(f"\\p{{Is{script}}}"))


def _dominant(script: str) -> Column:
    body = F.array_join(F.concat(F.transform(p("headings"), lambda h: h["text"]), p("blocks")), " ")
    letters = F.regexp_count(body, F.lit("\\p{L}"))
    return (letters >= 30) & (_script_letters(body, script) >= 0.8 * letters)


def _title_script_fails() -> Column:
    out = F.lit(False)
    for s in ("Latin", "Cyrillic", "Greek", "Han", "Arabic", "Hebrew"):
        out = out | (_dominant(s) & (_script_letters(p("title"), s) == 0))
    return out


def _title_script_applies() -> Column:
    out = F.lit(False)
    for s in ("Latin", "Cyrillic", "Greek", "Han", "Arabic", "Hebrew"):
        out = out | _dominant(s)
    return p("title").isNotNull() & out


def _title_year() -> Column:
    return F.regexp_extract(p("title"), "(?i)(?:\\b(?:in|for|of|en|pour|für|im|de)\\s+|^|[\\s(\\[])((?:19|20)\\d{2})(?:$|[)\\]:]|\\s+(?:guide|edition|update|review))", 1)


#: Regions that are reserved and name no country, and country codes taken for languages.
RESERVED_REGIONS = ("uk", "eu", "ez", "un", "ac", "cp", "dg", "ea", "ic", "ta")
COUNTRIES_AS_LANGUAGES = ("ua", "kz", "jp", "cn", "gr", "dk", "cz", "vn")


def hreflang_problem(lang: Column) -> Column:
    """What is wrong with an hreflang value, else null: a language of two letters, a script and a country may
    follow."""
    parts = F.split(F.lower(lang), "-")
    rest = F.filter(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), lambda x: ~x.rlike("^[a-z]{4}$"))
    region, first = F.get(rest, F.lit(0)), F.get(parts, F.lit(0))
    private = region.rlike("^(aa|zz|q[m-z]|x[a-z])$")
    return (
        F.when(F.lower(lang) == "x-default", F.lit(None).cast("string"))
        .when(lang.isNull() | ~lang.rlike("^[A-Za-z0-9]+(-[A-Za-z0-9]+)*$"), "not a language code")
        .when(first.rlike("^[a-z]{3}$"), "only two-letter language codes are supported")
        .when(~first.rlike("^[a-z]{2}$") | first.isin(*COUNTRIES_AS_LANGUAGES), "not a language code")
        .when(region.rlike("^[0-9]{3}$"), "only two-letter country codes are supported")
        .when(region.isNotNull() & ~region.rlike("^[a-z]{2}$"), "neither a script nor a country code")
        .when(region.isin(*RESERVED_REGIONS) | private, "not a country code")
        .when(F.size(rest) > 1, "more than a language, a script and a country")
    )


def _hreflang_bad(a: Column) -> Column:
    return hreflang_problem(a["lang"]).isNotNull() | a["href"].isNull()


def _crumb_bad(x: Column, last: Column) -> Column:
    return x["position"].isNull() | x["name"].isNull() | (x["item"].isNull() & ~last)


ERROR, WARNING, NOTICE = "error", "warning", "notice"
CATALOGUE: tuple[Check, ...] = (
    Check("TITLE_MISSING", ERROR, lambda: p("title").isNull()),
    Check("TITLE_LENGTH", NOTICE, lambda: ~F.length(p("title")).between(30, 60), lambda: p("title").isNotNull()),
    Check("TITLE_SCRIPT_MISMATCH", NOTICE, _title_script_fails, _title_script_applies),
    Check("TITLE_YEAR_OUTDATED", NOTICE, lambda: F.coalesce(F.try_to_number(F.nullif(_title_year(), F.lit("")), F.lit("9999")) < c("year"), F.lit(False)), lambda: p("title").isNotNull() & c("year").isNotNull()),
    Check("META_DESCRIPTION_MISSING", WARNING, lambda: p("meta_description").isNull()),
    Check("META_DESCRIPTION_LENGTH", NOTICE, lambda: ~F.length(p("meta_description")).between(70, 160), lambda: p("meta_description").isNotNull()),
    Check("META_DESCRIPTION_REPEATS_TITLE", NOTICE, lambda: F.array_contains(F.transform(F.array_append(texts.title_segments(p("title")), p("title")), lambda s: texts.normalised(s)), texts.normalised(p("meta_description"))), lambda: p("title").isNotNull() & p("meta_description").isNotNull()),
    Check("H1_MISSING", WARNING, lambda: F.size(p("h1s")) == 0),
    Check("H1_MULTIPLE", NOTICE, lambda: F.size(F.array_distinct(F.transform(p("h1s"), lambda h: F.lower(h)))) > 1),
    Check("HEADING_SKIP", NOTICE, lambda: F.exists(F.zip_with(F.slice(p("headings"), 1, F.size(p("headings")) - 1), F.slice(p("headings"), 2, F.size(p("headings")) - 1), lambda a, b: b["level"] - a["level"]), lambda d: d > 1), lambda: F.size(p("headings")) > 1),
    Check("NO_SUBHEADINGS", NOTICE, lambda: ~F.exists(p("headings"), lambda h: h["level"] > 1), _long),
    Check("CANONICAL_MISSING", WARNING, lambda: F.size(p("canonicals")) == 0),
    Check("CANONICAL_MISMATCH", NOTICE, _elsewhere, lambda: some(p("canonicals")) & ~urls.is_http_twin(_canonical(), c("final_url")) & (F.coalesce(c("canonical_status"), F.lit(200)) < 400)),
    Check("CANONICAL_TO_HTTP", WARNING, lambda: urls.is_http(_canonical()), lambda: some(p("canonicals")) & c("final_url").startswith("https:") & (urls.is_http_twin(_canonical(), c("final_url")) | ~_elsewhere())),
    Check("CANONICAL_TARGET_BROKEN", WARNING, lambda: (c("canonical_status") >= 300) | (c("canonical_status") == 0), lambda: _elsewhere() & c("canonical_status").isNotNull() & ~urls.is_dev_host(_canonical(), c("final_url"))),
    Check("CANONICAL_CONFLICT", WARNING, lambda: F.size(F.array_distinct(p("canonicals"))) > 1, lambda: some(p("canonicals"))),
    Check("DEVELOPMENT_HOST_REFERENCES", WARNING, lambda: F.exists(F.concat(p("canonicals"), p("links"), _resources(), F.transform(p("alternates"), lambda a: a["href"]), F.array(p("open_graph")["og:url"])), lambda u: urls.is_dev_host(u, c("final_url")))),
    Check("CANONICAL_RELATIVE", NOTICE, lambda: some(p("relative_canonicals")), lambda: some(p("canonicals")) | some(p("relative_canonicals"))),
    Check("NOINDEX", ERROR, lambda: _rules("noindex", "none") | _unavailable()),
    Check("SNIPPET_RESTRICTED", NOTICE, lambda: _rules("nosnippet", "max-snippet:0") | (p("nosnippet_share") > 0.5)),
    Check("IMAGE_PREVIEW_NOT_LARGE", NOTICE, lambda: _rules("max-image-preview:none", "max-image-preview:standard") | ~_directive("max-image-preview:large")),
    Check("ROBOTS_BLOCKS_GOOGLEBOT", ERROR, lambda: ~c("allows_googlebot"), lambda: c("allows_googlebot").isNotNull()),
    Check("ROBOTS_BLOCKS_RESOURCES", WARNING, lambda: some(F.filter(c("blocked_resources"), lambda u: ~F.contains(u, F.lit("/cdn-cgi/")))), lambda: c("blocked_resources").isNotNull() & some(_resources())),
    Check("ROBOTS_BLOCKS_AI_SEARCH", NOTICE, lambda: F.exists(c("allows_ai"), lambda a: ~a), lambda: c("allows_ai").isNotNull() & ~F.exists(c("allows_ai"), lambda a: a.isNull())),
    Check("IMAGES_MISSING_ALT", WARNING, lambda: F.exists(p("images"), lambda i: i["alt"].isNull()), lambda: some(p("images"))),
    Check("NO_IMAGES", NOTICE, lambda: (F.size(p("images")) == 0) & (p("embeds") == 0), _long),
    Check("IMAGES_NOT_INDEXABLE", WARNING, lambda: F.exists(p("images"), lambda i: i["src"].isNull() & i["srcset"].isNotNull()), lambda: some(p("images"))),
    Check("IMAGE_FILENAMES_GENERIC", NOTICE, lambda: F.exists(p("images"), lambda i: _stem_generic(i["src"])), lambda: F.exists(p("images"), lambda i: F.length(urls.file_name(i["src"])) > 0)),
    Check("VIDEO_WITHOUT_METADATA", NOTICE, lambda: ~F.array_contains(p("json_ld_types"), "VideoObject") & ~F.exists(F.map_keys(p("open_graph")), lambda k: k.startswith("og:video")), lambda: p("videos") > 0),
    Check("THIN_CONTENT", NOTICE, lambda: p("word_count") < SHORT_TEXT),
    Check("AUTHOR_MISSING", NOTICE, lambda: F.size(p("authors")) == 0),
    Check("DATE_BUMPED_WITHOUT_CHANGES", WARNING, lambda: (c("previous_hash") == p("content_hash")) & (c("previous_modified") != p("date_modified")), lambda: c("previous_hash").isNotNull() & c("previous_modified").isNotNull() & p("date_modified").isNotNull()),
    Check("NO_INTERNAL_LINKS", NOTICE, lambda: F.size(_internal()) == 0),
    Check("NO_EXTERNAL_SOURCES", NOTICE, lambda: ~F.exists(p("links"), lambda u: urls.organisation(u) != urls.organisation(c("final_url"))), _long),
    Check("INTERNAL_LINKS_NOFOLLOW", NOTICE, lambda: some(F.filter(F.array_intersect(_internal(), p("nofollow_links")), lambda u: urls.is_own_page(u))), lambda: some(_internal())),
    Check("INTERNAL_LINK_VARIANTS", NOTICE, lambda: F.exists(_internal(), lambda u: F.size(urls.link_variants(u, c("final_url"))) > 0), lambda: some(_internal())),
    Check("BROKEN_LINKS", NOTICE, lambda: _bad_links("link_status", lambda s: (s >= 400) | (s == 0)), lambda: c("link_status").isNotNull() & (F.size(c("link_status")) > 0)),
    Check("LINKS_TO_REDIRECTS", NOTICE, lambda: _bad_links("link_first_hop", lambda s: s.isin(301, 308)), lambda: c("link_first_hop").isNotNull() & (F.size(c("link_first_hop")) > 0)),
    Check("LINKS_WITHOUT_TEXT", NOTICE, lambda: F.exists(p("unnamed_links"), lambda u: urls.is_same_site(u, c("final_url")))),
    Check("UNCRAWLABLE_LINKS", NOTICE, lambda: some(p("uncrawlable_links"))),
    Check("LANG_MISSING", NOTICE, lambda: p("lang").isNull()),
    Check("HREFLANG_INVALID", NOTICE, lambda: F.exists(p("alternates"), lambda a: _hreflang_bad(a)), lambda: some(p("alternates"))),
    Check("HREFLANG_NO_SELF_REFERENCE", NOTICE, lambda: ~F.exists(p("alternates"), lambda a: urls.is_same_document(a["href"], c("final_url"))), lambda: some(p("alternates")) & ~_elsewhere()),
    Check("HREFLANG_NOT_RECIPROCAL", WARNING, lambda: F.exists(c("alternates_back"), lambda b: ~b), lambda: some(c("alternates_back"))),
    Check("VIEWPORT_MISSING", WARNING, lambda: p("viewport").isNull()),
    Check("OG_TAGS_MISSING", NOTICE, lambda: some(F.array_except(F.array(F.lit("og:title"), F.lit("og:description"), F.lit("og:image")), F.map_keys(p("open_graph")))) | ~F.coalesce(c("og_usable"), F.lit(True))),
    Check("OG_URL_MISMATCH", NOTICE, lambda: ~urls.is_same_document(p("open_graph")["og:url"], c("final_url")), lambda: (urls.host(p("open_graph")["og:url"]) != "") & ~urls.is_dev_host(p("open_graph")["og:url"], c("final_url")) & ~_elsewhere()),
    Check("PREVIEW_IMAGE_TOO_SMALL", NOTICE, lambda: c("preview_width") < 1200, lambda: c("preview_width").isNotNull() & ~F.coalesce(c("preview_is_logo"), F.lit(False))),
    Check("PREVIEW_IMAGE_IS_LOGO", NOTICE, lambda: F.coalesce(c("preview_is_logo"), F.lit(False)) | F.array_contains(p("logos"), p("open_graph")["og:image"]) | F.contains(F.lower(urls.file_name(p("open_graph")["og:image"])), F.lit("logo")), lambda: p("open_graph")["og:image"].isNotNull()),
    Check("CHARSET_MISSING_OR_LATE", WARNING, lambda: ~F.coalesce(F.contains(F.lower(c("content_type")), F.lit("charset=")), F.lit(False)) & (F.coalesce(p("charset_declaration_end"), F.lit(1 << 30)) > 1024)),
    Check("NOT_HTTPS", ERROR, lambda: urls.is_http(c("final_url"))),
    Check("MIXED_CONTENT", WARNING, lambda: F.exists(_resources(), lambda u: urls.is_http(u)) & ~p("csp_upgrades"), lambda: c("final_url").startswith("https:")),
    Check("REDIRECTED", NOTICE, lambda: c("redirected"), lambda: c("redirected").isNotNull()),
    Check("META_REFRESH", WARNING, lambda: F.coalesce(p("meta_refresh").rlike("(?i)^\\s*[0-9.]+\\s*[;,]\\s*(url\\s*=)?\\s*\\S"), F.lit(False))),
    Check("LARGE_PAGE", NOTICE, lambda: p("html_bytes") > (1 << 20)),
    Check("LCP_IMAGE_LAZY_LOADED", NOTICE, lambda: F.lower(p("featured_loading")) == "lazy", lambda: p("featured_loading").isNotNull()),
    Check("RENDER_BLOCKING_SCRIPTS", NOTICE, lambda: some(p("render_blocking_scripts"))),
    Check("FONT_PRELOAD_WITHOUT_CROSSORIGIN", NOTICE, lambda: some(p("font_preloads_without_crossorigin"))),
    Check("BFCACHE_BLOCKED_BY_NO_STORE", NOTICE, lambda: F.coalesce(c("cache_control").rlike("(?i)(^|[\\s,])no-store"), F.lit(False))),
    Check("DOM_SIZE_LARGE", NOTICE, lambda: p("element_count") > 1400),
    Check("HTML_NOT_COMPRESSED", NOTICE, lambda: ~F.lower(F.coalesce(c("content_encoding"), F.lit("identity"))).isin("gzip", "deflate", "br", "zstd"), lambda: c("content_type").isNotNull()),
    Check("KEYWORD_CANNIBALISATION", WARNING, lambda: c("keyword_pages") > 1, lambda: (c("run_pages") > 1) & c("top_keyword").isNotNull()),
    Check("TITLE_DUPLICATE", WARNING, lambda: c("title_pages") > 1, lambda: (c("run_pages") > 1) & (F.coalesce(texts.normalised(p("title")), F.lit("")) != "")),
    Check("META_DESCRIPTION_DUPLICATE", NOTICE, lambda: c("description_pages") > 1, lambda: (c("run_pages") > 1) & (F.coalesce(texts.normalised(p("meta_description")), F.lit("")) != "")),
    Check("NEAR_DUPLICATE_CONTENT", WARNING, lambda: F.coalesce(c("near_pages"), F.lit(0)) > 0, lambda: (c("run_pages") > 1) & (c("n_shingles") >= LEAST_SHINGLES)),
    Check("STRUCTURED_DATA_INVALID", WARNING, lambda: p("json_ld_errors") > 0, lambda: (p("json_ld_errors") > 0) | some(p("json_ld_types"))),
    Check("DATES_INCONSISTENT", NOTICE, lambda: F.coalesce(_modified() < _published() - F.expr("INTERVAL 60 SECONDS"), F.lit(False)) | F.coalesce(_published() > c("fetched_at") + F.expr("INTERVAL 24 HOURS"), F.lit(False)) | F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c("final_url"), "/((?:19|20)[0-9]{2})/", 1), F.lit("")), F.lit("9999")) != F.year(_published()), F.lit(False)), lambda: _published().isNotNull()),
    Check("STRUCTURED_DATA_MISSING", NOTICE, lambda: ~F.arrays_overlap(p("json_ld_types"), F.array(*map(F.lit, ARTICLE_TYPES))) & (F.size(p("article_fields")) == 0)),
    Check("STRUCTURED_DATA_INCOMPLETE", NOTICE, lambda: some(F.array_except(F.array(*map(F.lit, ARTICLE_FIELDS)), p("article_fields"))), lambda: some(p("article_fields"))),
    Check("AUTHOR_MARKUP_INCOMPLETE", NOTICE, lambda: F.exists(p("authors"), lambda a: a.rlike("(?i)^(by|author|posted by)\\b|,|https?:")), lambda: some(p("authors"))),
    Check("ARTICLE_DATE_FORMAT_INVALID", NOTICE, lambda: F.exists(F.array_compact(F.array(p("date_published"), p("date_modified"))), lambda d: ~d.rlike(_ISO) | (F.contains(d, F.lit("T")) & ~d.rlike("(Z|[+-]\\d{2}:?\\d{2})$"))), lambda: p("date_published").isNotNull() | p("date_modified").isNotNull()),
    Check("ARTICLE_HEADLINE_MISMATCH", NOTICE, lambda: F.size(F.array_intersect(F.array_distinct(F.split(texts.normalised(p("headline")), " ")), _title_words())) < 0.5 * F.size(F.array_distinct(F.split(texts.normalised(p("headline")), " "))), lambda: p("headline").isNotNull() & (p("title").isNotNull() | some(p("h1s")))),
    Check("BREADCRUMB_MISSING", NOTICE, lambda: p("breadcrumbs").isNull(), lambda: ~p("client_rendered")),
    Check("BREADCRUMB_INVALID", WARNING, lambda: (F.size(p("breadcrumbs")) == 0) | F.exists(F.transform(p("breadcrumbs"), lambda x, i: _crumb_bad(x, i == F.size(p("breadcrumbs")) - 1)), lambda b: b), lambda: p("breadcrumbs").isNotNull()),
)
BY_CODE = {x.code: x for x in CATALOGUE}


#: What the run rules ask for.
RUN_FACTS = {
    "KEYWORD_CANNIBALISATION": ("run_pages", "keyword_pages"),
    "TITLE_DUPLICATE": ("run_pages", "title_pages"),
    "META_DESCRIPTION_DUPLICATE": ("run_pages", "description_pages"),
    "NEAR_DUPLICATE_CONTENT": ("run_pages", "near_pages"),
}
VALUES = {
    "title_pages": lambda: texts.normalised(p("title"), whole=True),
    "description_pages": lambda: texts.normalised(p("meta_description"), whole=True),
    "keyword_pages": lambda: c("top_keyword"),
}


def _comparable(url: Column) -> Column:
    """Host and path without trailing slashes; what cannot be read stays as it is."""
    return F.when(urls.host(url) != "", F.concat(urls.host(url), F.regexp_replace(urls.path(url), "/+$", ""))).otherwise(url)


def same_value_pages(slim: DataFrame, name: str) -> DataFrame:
    """From slim (page_id, run, url, value, lang, at, alternates) the page_id and, as `name`, one and how many
    other URLs of the run have the same value and are no language versions of the page: neither names the
    other as an alternate, and their languages don't both exist and differ.

    Counts are aggregates; only alternates are followed one by one.
    """
    own = slim.where(F.coalesce("value", F.lit("")) != "").withColumn("lang", F.nullif(F.lower(F.trim("lang")), F.lit("")))
    places = own.select("run", "value", "url", "lang", "at").distinct()
    by_lang = places.groupBy("run", "value", "lang").agg(F.countDistinct("url").alias("n"))
    of_lang = F.map_from_entries(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "n"))))  # as many as languages
    totals = by_lang.groupBy("run", "value").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("lang").isNull(), F.col("n")).otherwise(0)).alias("unknown"), of_lang.alias("known"))
    named = own.select("run", "value", "url", "lang", F.explode(F.array_distinct(F.transform("alternates", _comparable))).alias("at"))
    met = named.join(places.select("run", "value", "at", F.col("url").alias("other"), F.col("lang").alias("other_lang")), ["run", "value", "at"]).where("url != other")
    met = met.where(F.coalesce(F.col("lang") == F.col("other_lang"), F.lit(True))).select("run", "value", "url", "other")
    both = met.unionByName(met.select("run", "value", F.col("other").alias("url"), F.col("url").alias("other")))
    versions = both.groupBy("run", "value", "url").agg(F.countDistinct("other").alias("versions"))
    alike = F.when(F.col("lang").isNull(), F.col("total")).otherwise(F.col("unknown") + F.coalesce(F.col("known")[F.col("lang")], F.lit(0)))
    out = own.join(totals, ["run", "value"]).join(versions, ["run", "value", "url"], "left")
    return out.select("page_id", (alike - F.coalesce("versions", F.lit(0))).alias(name))


def with_facts(pages: DataFrame, run: str, chosen: list[Check] | None = None) -> DataFrame:
    """pages (page_id, run column, url, page) with every fact, null where it was not gathered, and the
    counts that the chosen run rules ask for (all rules, if none are given)."""
    missing = {f: F.lit(None).cast(t) for f, t in FACTS.items() if f not in pages.columns}
    if "final_url" in missing:
        missing["final_url"] = F.col("url")
    out = pages.withColumns(missing)
    wanted = {f for x in (CATALOGUE if chosen is None else chosen) for f in RUN_FACTS.get(x.code, ())}
    if not wanted:
        return out
    # parsed once, whatever follows
    out = written(out, "pages")
    own = F.col(run).alias("run")
    counts = out.groupBy(run).agg(F.count(F.lit(1)).alias("run_pages"))
    result = out.join(counts, run, "left")
    for name, value in VALUES.items():
        if name in wanted:
            slim = out.select("page_id", own, "url", value().alias("value"), p("lang").alias("lang"), _comparable(c("final_url")).alias("at"), F.transform(p("alternates"), lambda a: a["href"]).alias("alternates"))
            result = result.join(same_value_pages(slim, name), "page_id", "left")
    if "near_pages" in wanted:
        result = result.join(near_duplicates(out.select("page_id", own, F.array_join(p("blocks"), " ").alias("text"))), "page_id", "left")
    return result


def near_duplicates(texts_: DataFrame, threshold: float = NEAR) -> DataFrame:
    """Of (page_id, run, text): page_id, n_shingles and near_pages, how many other pages of the run have a
    5-word-shingle similarity of the threshold or more, both with enough shingles.

    Pages of equal sets are one node, counted by its pages. What only one node of a run holds it can share
    with none, so it is counted and dropped; of the rest the rarest are a node's prefix, of which any two
    similar nodes share one, so common passages make no pairs.
    """
    tokens = F.split(texts.normalised(c("text")), " ")
    cut = texts_.select("page_id", "run", tokens.alias("tokens"))
    hashed = F.when(F.size("tokens") >= 5, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("tokens") - 5), lambda i: F.xxhash64(*[F.get("tokens", i + k) for k in range(5)])))))
    sets = written(cut.select("page_id", "run", F.coalesce(hashed, F.array().cast("array<bigint>")).alias("s")), "shingles")
    sized = sets.select("page_id", "run", "s", F.size("s").alias("n_shingles"), F.xxhash64("s").alias("one"), F.hash("s").alias("two"))
    same = ["run", "one", "two", "n_shingles"]
    classes = sized.where(F.col("n_shingles") >= LEAST_SHINGLES).groupBy(*same).agg(F.min("page_id").alias("node"), F.count(F.lit(1)).alias("pages"))
    nodes = written(classes, "shingle-classes")
    own = sized.select("page_id", "run", "s", "n_shingles").join(nodes.select(F.col("node").alias("page_id"), "node"), "page_id")
    elements = own.select("run", "node", F.col("n_shingles").alias("n"), F.explode("s").alias("key"))
    often = elements.groupBy("run", "key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = elements.join(often, ["run", "key"])
    by_node = W.partitionBy("run", "node")
    ranked = shared.withColumns({"rank": F.row_number().over(by_node.orderBy("df", "key")), "held": F.count(F.lit(1)).over(by_node)})
    # the n-grams that a node has alone come first in the order and take their places in the prefix
    keys = ranked.where(F.col("rank") <= F.col("held") - F.ceil(F.col("n") * threshold) + 1).select("run", "node", "n", "key", (F.col("held") - F.col("rank")).alias("rest"))
    a, b = (keys.select("run", "key", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("rest").alias(f"r{x}")) for x in "ab")
    need = F.ceil((F.col("na") + F.col("nb")) * threshold / (1 + threshold) - 1e-9)
    fits = (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold) & (1 + F.least("ra", "rb") >= need)
    pairs = a.join(b, ["run", "key"]).where((F.col("a") < F.col("b")) & fits).select("run", "a", "b", "na", "nb").distinct()
    left, right = (own.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    similar = pairs.join(left, "a").join(right, "b").where(texts.jaccard(F.col("sa"), F.col("sb")) >= threshold).select("a", "b")
    links = similar.unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(nodes.select(F.col("node").alias("b"), "pages"), "b")
    linked = links.groupBy(F.col("a").alias("node")).agg(F.sum("pages").alias("others"))
    counted = nodes.join(linked, "node", "left").select(*same, F.nullif(F.col("pages") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).alias("near_pages"))
    return sized.select("page_id", *same).join(counted, same, "left").select("page_id", "n_shingles", "near_pages")


def outcome(check: Check) -> Column:
    return F.when(F.col("page").isNull() | ~F.coalesce(check.applies(), F.lit(False)), "notApplicable").when(F.coalesce(check.fails(), F.lit(False)), "fails").otherwise("pass")


def evaluate(pages: DataFrame, run: str, codes: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each page and check: page_id, run, code, severity, outcome."""
    chosen = [x for x in CATALOGUE if codes is None or x.code in codes]
    facts = with_facts(pages, run, chosen)
    if len(chosen) > 8:
        # the optimizer then plans the rules apart from the joins below them, which together take it minutes
        facts = written(facts, "facts")
    rows = [F.struct(F.lit(x.code).alias("code"), F.lit(x.severity).alias("severity"), outcome(x).alias("outcome")) for x in chosen]
    return facts.select("page_id", run, F.explode(F.array(*rows)).alias("x")).select("page_id", run, "x.code", "x.severity", "x.outcome")


def summary(evaluated: DataFrame, run: str) -> DataFrame:
    """Of each page the codes judged, failed and not applicable, and its score."""
    weight = F.when(c("severity") == ERROR, 10).when(c("severity") == WARNING, 3).otherwise(1)
    judged = c("outcome") != "notApplicable"
    codes = lambda test: F.array_sort(F.collect_list(F.when(test, c("code"))))
    out = evaluated.groupBy("page_id", run).agg(
        codes(judged).alias("judged"), codes(c("outcome") == "fails").alias("failed"), codes(~judged).alias("not_applicable"),
        F.sum(F.when(judged, weight)).alias("possible"), F.sum(F.when(c("outcome") == "fails", weight)).alias("lost"),
    )
    lost = F.coalesce("lost", F.lit(0))
    return out.withColumn("lost", lost).withColumn("score", F.floor(100.0 * (F.col("possible") - lost) / F.col("possible") + 0.5))
