"""Facts of a crawl that checks ask for beside the HTML: robots verdicts, the crawl before, answers of links.

Each is a join on a key or a rule over one row; a fact that is not known stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions import urls
from siteglass.sources import discovery

#: The agents of search and of assistants that answer from pages.
SEARCH_AGENT = "Googlebot"
AI_AGENTS = ("OAI-SearchBot", "ChatGPT-User", "PerplexityBot", "Claude-SearchBot")


def robots_verdicts(pages: DataFrame) -> DataFrame:
    """pages (page_id, robots, final_url, page) with allows_googlebot, allows_ai (by agent) and blocked_resources
    (of the page's own site); null where the site's robots file is not known."""
    from siteglass.sources.shipping import ship

    ship(pages.sparkSession)
    own = F.filter(F.col("page.resource_urls"), lambda u: urls.is_same_site(u, F.col("final_url")))
    asked = pages.select("page_id", "robots", "final_url", own.alias("resources"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, robots, url, resources in zip(b["page_id"], b["robots"], b["final_url"], b["resources"], strict=True):
                allows = lambda agent, u, text=robots: discovery.robots_rule(text, agent, u)[0]
                known = robots is not None and url is not None
                rows.append((i, allows(SEARCH_AGENT, url), [allows(a, url) for a in AI_AGENTS], [u for u in (resources if resources is not None else ()) if not allows(SEARCH_AGENT, u)]) if known else (i, None, None, None))
            yield pd.DataFrame(rows, columns=["page_id", "allows_googlebot", "allows_ai", "blocked_resources"])

    found = asked.mapInPandas(run, "page_id long, allows_googlebot boolean, allows_ai array<boolean>, blocked_resources array<string>")
    return pages.join(found, "page_id", "left")


def link_answers(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """pages with link_status and link_first_hop, the statuses of the page's links that were asked (answers: link,
    status), and canonical_status, that of its canonical URL; null where none was asked."""
    links = pages.select("page_id", F.explode(F.array_distinct("page.links")).alias("link")).join(answers, "link")
    by_page = links.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("link", "status"))).alias("link_status"))
    canonical = pages.select("page_id", F.get("page.canonicals", F.lit(0)).alias("link")).join(answers, "link").select("page_id", F.col("status").alias("canonical_status"))
    return pages.join(by_page.withColumn("link_first_hop", F.col("link_status")), "page_id", "left").join(canonical, "page_id", "left")


def alternates_back(pages: DataFrame) -> DataFrame:
    """pages with alternates_back: for each alternate that the crawl has, whether it names the page in turn."""
    key = lambda u: urls.page_key(u)
    named = pages.select("page_id", key(F.col("final_url")).alias("own"), F.explode("page.alternates").alias("a")).select("page_id", "own", key(F.col("a.href")).alias("other")).where("own != other")
    theirs = pages.select(key(F.col("final_url")).alias("other"), F.transform("page.alternates", lambda a: key(a["href"])).alias("back"))
    met = named.join(theirs, "other").groupBy("page_id").agg(F.collect_list(F.expr("array_contains(back, own)")).alias("alternates_back"))
    return pages.join(met, "page_id", "left")


def top_keywords(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages with top_keyword, the first of the page's keywords (found: page_id, term, relevance)."""
    best = found.groupBy("page_id").agg(F.max_by("term", F.struct("relevance", "term")).alias("top_keyword"))
    return pages.join(best, "page_id", "left")


def gathered(pages: DataFrame, before: DataFrame, answers: DataFrame) -> DataFrame:
    """pages with every fact that can be gathered from the crawl itself: before has page_id, previous_hash and
    previous_modified; a page's own title stands for its top keyword where no keywords were chosen."""
    from siteglass.functions import texts
    from siteglass.sources.scratch import written

    out = written(pages, "crawled")
    out = alternates_back(link_answers(robots_verdicts(out), answers)).join(before, "page_id", "left")
    return out.withColumn("top_keyword", F.nullif(texts.normalised(F.col("page.title")), F.lit(""))).drop("robots")
