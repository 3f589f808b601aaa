"""Text queries: near duplicates, the keyword pipeline and the walk of positions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteglass.functions import bands, texts, urls
from siteglass.operators import checks, keywords, ranks
from siteglass.plans import model as m
from siteglass.plans.registry import query
from siteglass.sources import html


#: The fields of a page's record that keywords are read from.
_RECORD = ("title", "meta_description", "lang", "h1s", "headings", "first_paragraph", "blocks", "word_count")


def pages(spark, sf_dir):
    """A row for each page: run, page_id, lang, words, and texts, its fields that keywords are read from."""
    p = html.parse_pages(m.table(spark, sf_dir, "pages").select("page_id", "url", "html"), fields=_RECORD)
    p = p.withColumn("site", urls.site_key(F.col("url"))).withColumn("slug", F.regexp_replace(urls.stem(F.col("url")), "[-_]", " "))
    main = F.get(F.transform(F.filter("page.headings", lambda h: h["level"] == 1), lambda h: h["text"]), F.lit(0))
    p = p.withColumn("title", keywords.clauses(F.col("page.title"), F.col("slug"))).withColumn("h1", keywords.clauses(F.coalesce(main, F.get("page.h1s", F.lit(0))), F.col("slug")))
    headings = F.transform(F.filter("page.headings", lambda h: h["level"].isin(2, 3)), lambda h: h["text"])
    texts_of = {
        "title": F.slice("title", 1, 1), "titleTail": F.concat(F.slice("title", 2, 1 << 20), F.slice("h1", 2, 1 << 20)), "h1": F.slice("h1", 1, 1), "slug": F.array("slug"),
        "meta": F.array("page.meta_description"), "subheading": headings, "firstParagraph": F.array("page.first_paragraph"), "body": F.col("page.blocks"),
    }

    # texts stay apart, so that no term runs from one into the next
    def of(field, found):
        return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.struct(F.lit(field).alias("field"), F.coalesce(t, F.lit("")).alias("text")))

    parts = F.flatten(F.array(*[of(k, v) for k, v in texts_of.items()]))
    return p.select(F.col("site").alias("run"), "page_id", texts.iso_language(F.col("page.lang")).alias("lang"), F.col("page.word_count").alias("words"), parts.alias("texts"))


def fields(spark, sf_dir):
    """The fields of each page that keywords are read from, a row for each text; and words, the pages' lengths."""
    p = pages(spark, sf_dir)
    return p.select("run", "page_id", "lang", F.explode("texts").alias("x")).select("run", "page_id", "lang", "x.*"), p.select("page_id", "words")


@query("kw_collect")
def kw_collect(spark, sf_dir):
    return keywords.collected(pages(spark, sf_dir)).select("run", "page_id", "term", "n_words", "tf", F.array_sort("fields").alias("fields"))


@query("kw_page_score")
def kw_page_score(spark, sf_dir):
    rows = keywords.scored(pages(spark, sf_dir), names=False).select("run", "page_id", F.explode("found").alias("t"))
    return rows.select("run", "page_id", "t.term", F.round("t.score", 6).alias("score"), "t.df")


@query("kw_subsume")
def kw_subsume(spark, sf_dir):
    return keywords.subsumed(keywords.scored(pages(spark, sf_dir), names=False))


@query("kw_select")
def kw_select(spark, sf_dir):
    return keywords.selected(keywords.scored(pages(spark, sf_dir)))


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9\\x{00c0}-\\x{024f}]+'), lambda w: w <> '')"


@query("kw_df", f"SELECT source, word, count(DISTINCT doc_id) AS df FROM (SELECT source, doc_id, unnest({_WORDS}) AS word FROM documents) GROUP BY ALL HAVING count(DISTINCT doc_id) > 1", prelude=False)
def kw_df(spark, sf_dir):
    """All documents of a source count, whatever their length."""
    d = m.table(spark, sf_dir, "documents")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9\\u00c0-\\u024f]+"), lambda w: w != ""))
    rows = d.select("source", "doc_id", F.explode(words).alias("word"))
    return rows.groupBy("source", "word").agg(F.countDistinct("doc_id").alias("df")).where("df > 1")


@query("kw_idf_score", "SELECT p_brand, p_size, round(CASE WHEN n <= 1 THEN 1.0 WHEN p_size % 2 = 0 AND df <= 0.15 * n THEN 1 - 0.5 * (1 - ln(1 + n / df::DOUBLE) / ln(1 + n)) ELSE ln(1 + n / df::DOUBLE) / ln(1 + n) END, 9) AS idf FROM (SELECT p_brand, p_size, count(*) AS df FROM part GROUP BY ALL) JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY ALL) USING (p_brand)", prelude=False)
def kw_idf_score(spark, sf_dir):
    """Sizes of a brand's parts as terms of its pages; those of even size stand in a title."""
    p = m.table(spark, sf_dir, "part")
    df = p.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("df"))
    n = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return df.join(n, "p_brand").select("p_brand", "p_size", F.round(bands.idf(F.col("n"), F.col("df"), F.col("p_size") % 2 == 0), 9).alias("idf"))


def _shared_sql(values: str) -> str:
    """Values that at least two and half of a run's pages hold."""
    return f"SELECT p_brand, value, count(DISTINCT p_partkey) AS pages FROM (SELECT p_brand, p_partkey, unnest({values}) AS value FROM part) JOIN (SELECT p_brand, greatest(2, ceil(count(*) * 0.5)) AS least FROM part GROUP BY p_brand) USING (p_brand) GROUP BY p_brand, value, least HAVING count(DISTINCT p_partkey) >= least"


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("kw_title_chrome", _shared_sql(f"[{_PLAIN.format('p_type')}, {_PLAIN.format('p_brand')}]"), prelude=False)
def kw_title_chrome(spark, sf_dir):
    """Tail parts of titles that half of a run's pages repeat."""
    p = m.table(spark, sf_dir, "part")
    return keywords.title_chrome(p, "p_brand", "p_partkey", F.concat("p_name", F.lit(" - "), "p_type", F.lit(" | "), "p_brand"))


@query("kw_taxonomy", _shared_sql("list_distinct(list_transform(string_split(p_type, ' '), lambda w: lower(w)))").replace("greatest(2, ceil(count(*) * 0.5))", "greatest(2, ceil(count(DISTINCT p_partkey) * 0.5))"), prelude=False)
def kw_taxonomy(spark, sf_dir):
    """Declared keywords that half of a run's pages repeat; the words of a part's type stand for them."""
    return keywords.repeated_values(m.table(spark, sf_dir, "part"), "p_brand", "p_partkey", F.split("p_type", " "))


@query("kw_repeated_runs")
def kw_repeated_runs(spark, sf_dir):
    """Short runs of words that a document repeats: no text of its own."""
    return keywords.repeated_runs(m.table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("kw_profile")
def kw_profile(spark, sf_dir):
    return keywords.profile(spark)


@query("fn_tokenize")
def fn_tokenize(spark, sf_dir):
    runs = m.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(texts.tokenize(F.col("text"))).alias("run", "r"))
    return runs.select("doc_id", "run", F.array_join(F.col("r")["token"], " ").alias("tokens"), F.size(F.filter("r", lambda t: t["glued"])).alias("glued"))


@query("fn_proper_nouns", """SELECT doc_id, word FROM (SELECT doc_id, lower(raw) AS word, raw FROM (SELECT doc_id, regexp_replace(x, '^[^\\p{L}]+', '') AS raw, i, x FROM (SELECT doc_id, unnest(found) AS x, unnest(range(len(found))) AS i
FROM (SELECT doc_id, regexp_extract_all(text, '[^\\p{L}]*\\p{L}[\\p{L}\\p{N}''’-]*') AS found FROM documents))) WHERE i > 0 AND NOT regexp_matches(regexp_extract(x, '^[^\\p{L}]*'), '[.!?…]') AND NOT regexp_matches(raw, '[^\\p{L}\\p{N}]') AND length(raw) >= 2)
GROUP BY doc_id, word HAVING sum(CASE WHEN left(raw, 1) <> lower(left(raw, 1)) THEN 1 ELSE 0 END) >= 0.6 * count(*)""", prelude=False)
def fn_proper_nouns(spark, sf_dir):
    """A document's text is one block here. Words joined by a mark are none, in both."""
    d = m.table(spark, sf_dir, "documents").where("text is not null")
    return keywords.proper_nouns(d, "doc_id", F.array("text"))


@query("fn_strip_title_chrome", "SELECT p_partkey, p_name AS title FROM part", prelude=False)
def fn_strip_title_chrome(spark, sf_dir):
    """Titles without the brand, which the run's title chrome names, and the site's name."""
    p = m.table(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit(" - "), "p_type", F.lit(" | "), "p_brand")
    site = F.concat(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(".example"))
    return p.select("p_partkey", texts.strip_title_chrome(title, site, F.col("p_brand"), F.array(texts.normalised(F.col("p_type")))).alias("title"))


@query("fn_named_clause", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS head, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS tail FROM part", prelude=False)
def fn_named_clause(spark, sf_dir):
    """The clause of a title that names the page: the slug is made of the second clause of every other part."""
    p = m.table(spark, sf_dir, "part").withColumn("slug", F.when(F.col("p_partkey") % 2 == 0, F.replace("p_type", F.lit(" "), F.lit("-"))).otherwise("zzz"))
    found = p.withColumn("x", keywords.clauses(F.concat("p_name", F.lit(": "), "p_type"), F.col("slug")))
    return found.select("p_partkey", F.get("x", F.lit(0)).alias("head"), F.get("x", F.lit(1)).alias("tail"))


@query("join_self_pairs")
def join_self_pairs(spark, sf_dir):
    """Near duplicates within a run (a source): shingles meet on their prefix, never as all pairs."""
    d = m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("run"), "text")
    return checks.near_duplicates(d).select("page_id", "n_shingles", F.coalesce("near_pages", F.lit(0)).alias("near_pages"))


@query("win_walk")
def win_walk(spark, sf_dir):
    p = m.table(spark, sf_dir, "pages").select("page_id", "url", F.lit("term").alias("term"), F.lit(0.7).alias("relevance"), F.lit(1).cast("long").alias("first_day"), F.lit(30).cast("long").alias("days"), F.lit(None).cast("long").alias("last"))
    return ranks.simulate(p)


@query(
    "kw_eval",
    """SELECT CAST(count(*) FILTER (quality = 1) AS BIGINT) AS good, CAST(count(*) FILTER (quality = 0) AS BIGINT) AS junk, CAST(count(*) FILTER (quality IS NULL) AS BIGINT) AS unlabelled, count(*) AS total,
    CAST(count(*) FILTER (quality = 1 AND rank = 1) AS BIGINT) AS primary_good, (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) + 1 AS pages, CAST(1 AS BIGINT) AS empty_pages, count(*) FILTER (quality = 1) / count(*) AS precision
    FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) LEFT JOIN labels USING (doc_id)""",
    prelude=False,
)
def kw_eval(spark, sf_dir):
    """The scorer of keywords; a source stands for a page, its documents for terms, their labels for marks, and
    one page has no terms."""
    d = m.table(spark, sf_dir, "documents").select(F.col("source").alias("page"), F.col("doc_id").alias("term"))
    ranked = d.withColumn("rank", F.row_number().over(W.partitionBy("page").orderBy("term")))
    marks = m.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("term"), (F.col("quality") == 1).alias("good")).join(d, "term")
    pages = d.select("page").distinct().unionByName(spark.createDataFrame([("no terms",)], "page string"))
    return keywords.evaluate(ranked, pages, marks)
