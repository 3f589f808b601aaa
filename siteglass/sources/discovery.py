"""What a site publishes about itself: sitemaps, feeds, robots rules, search-update incidents.

Readers of one document are plain functions; `read_documents` runs one over a table of documents in
Arrow batches.
"""

from __future__ import annotations

import gzip
import json
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes beyond which a document is cut or refused.
ROBOTS_BYTES, SITEMAP_BYTES = 500 * 1024, 50 << 20


def inflate(data: bytes) -> bytes | None:
    """gzip by its magic bytes, others as they are; None beyond SITEMAP_BYTES."""
    if data[:2] != b"\x1f\x8b":
        return data if len(data) <= SITEMAP_BYTES else None
    try:
        found = zlib.decompressobj(31).decompress(data, SITEMAP_BYTES + 1)
    except zlib.error:
        return None
    return found if len(found) <= SITEMAP_BYTES else None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _child(node: ET.Element, name: str) -> str | None:
    return next(((x.text or "").strip() for x in node if _local(x.tag) == name), None)


def read_sitemap(text: str | None) -> dict:
    """{kind: urlset, index or invalid; urls; lastmods; news}: XML with any prefixes, or a text sitemap,
    every line of which must be an absolute http(s) URL."""
    empty = {"kind": "invalid", "urls": [], "lastmods": [], "news": 0}
    body = (text or "").lstrip("﻿ \t\r\n")
    if not body.startswith("<"):
        lines = [x.strip() for x in body.splitlines() if x.strip()]
        return {**empty, "kind": "urlset", "urls": lines, "lastmods": [None] * len(lines)} if lines and all(re.match("https?://[^\\s/]+", x) for x in lines) else empty
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return empty
    kind = {"urlset": "urlset", "sitemapindex": "index"}.get(_local(root.tag))
    if kind is None:
        return empty
    entries = [x for x in root if _local(x.tag) in ("url", "sitemap") and _child(x, "loc")]
    return {"kind": kind, "urls": [_child(x, "loc") for x in entries], "lastmods": [_child(x, "lastmod") for x in entries], "news": sum(_local(y.tag) == "news" for x in entries for y in x)}


def strip_tracking(url: str) -> str:
    bare = url.split("#")[0]
    head, mark, query = bare.partition("?")
    kept = [p for p in query.split("&") if p and not p.lower().startswith("utm_")]
    return head + ("?" + "&".join(kept) if kept else "")


def read_feed(text: str | None) -> list[str]:
    """Links of RSS 2.0, RDF, Atom and JSON feeds, without tracking: the original link, else the
    alternate one, else a permanent id."""
    body = (text or "").lstrip("﻿ \t\r\n")
    found: list[str | None] = []
    if body.startswith("{"):
        try:
            items = json.loads(body).get("items") or []
        except ValueError:
            return []
        found = [x.get("url") or x.get("external_url") for x in items if isinstance(x, dict)]
    else:
        try:
            root = ET.fromstring(body)
        except ET.ParseError:
            return []
        for item in root.iter():
            if _local(item.tag) not in ("item", "entry"):
                continue
            link = _child(item, "origlink")
            for x in item:
                if not link and _local(x.tag) == "link":
                    link = x.get("href") if x.get("rel", "alternate") == "alternate" and x.get("href") else (x.text or "").strip()
            guid = next((x for x in item if _local(x.tag) == "guid"), None)
            if not link and guid is not None and guid.get("isPermaLink", "true") != "false":
                link = (guid.text or "").strip()
            found.append(link)
    return list(dict.fromkeys(strip_tracking(x) for x in found if x and re.match("https?://", x)))


def read_robots(text: str | None) -> tuple[list[tuple[list[str], list[tuple[bool, str]]]], list[str]]:
    """Groups of (agents, rules as (allow, pattern)) and the sitemaps of a robots file."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    sitemaps, naming = [], False
    for line in (text or "")[:ROBOTS_BYTES].lstrip("﻿").splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not naming:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            naming = True
        elif key in ("allow", "disallow"):
            naming = False
            if groups and value:
                groups[-1][1].append((key == "allow", value))
        elif key == "sitemap":
            sitemaps.append(value)
    return groups, sitemaps


def robots_allows(text: str | None, agent: str, url: str) -> bool:
    """The longest matching rule of the agent's groups, or of *; equal lengths allow."""
    groups, _ = read_robots(text)
    name = agent.lower()
    own = [r for agents, rules in groups if any(a != "*" and a in name for a in agents) for r in rules]
    if not any(a != "*" and a in name for agents, _ in groups for a in agents):
        own = [r for agents, rules in groups if "*" in agents for r in rules]
    parts = urlsplit(url)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    best = (0, True)
    for allow, pattern in own:
        body = pattern.removesuffix("$")
        regex = ".*".join(map(re.escape, body.split("*"))) + ("$" if pattern.endswith("$") else "")
        if re.match(regex, path):
            best = max(best, (len(pattern), allow))
    return best[1]


def robots_rule(text: str | None, agent: str, url: str) -> tuple[bool, int | None]:
    """Whether the agent may read the URL, and the line (from 1) of the rule that says so, None without one: of the
    agent's own groups, or else of those for all, the longest pattern that fits; of equal ones one that allows."""
    groups: list[tuple[set[str], list[tuple[int, bool, str]]]] = []
    naming = False
    for number, line in enumerate((text or "")[:ROBOTS_BYTES].lstrip("\ufeff").splitlines(), 1):
        key, colon, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if colon and key == "user-agent":
            if not naming:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            naming = True
        elif colon and key in ("allow", "disallow"):
            naming = False
            if groups and value:
                groups[-1][1].append((number, key == "allow", value))
    name = agent.lower()
    own = [rules for agents, rules in groups if any(a != "*" and a in name for a in agents)] or [rules for agents, rules in groups if "*" in agents]
    parts = urlsplit(url)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    best: tuple[int, bool, int] | None = None
    for number, allow, pattern in (x for rules in own for x in rules):
        body = pattern.removesuffix("$")
        regex = ".*".join(map(re.escape, body.split("*"))) + ("$" if pattern.endswith("$") else "")
        if re.match(regex, path) and (best is None or (len(pattern), allow) > best[:2]):
            best = (len(pattern), allow, number)
    return (True, None) if best is None else (best[1], best[2])


#: Where posts are looked for, the surest source first.
BLOG_SOURCES = ("sitemap", "feed", "listing", "unconfirmed-sitemap")
#: Segments of links to further listings.
LISTING_SEGMENTS = ("page", "tag", "tags", "category", "categories", "author", "authors", "topic", "topics", "feed", "rss", "search", "tagged")


def blog_sources(found: DataFrame, site: str) -> DataFrame:
    """From found (site, source, confirmed, urls) the source of each site's posts: a confirmed sitemap, else the
    feed, else a listing, else the least unlikely sitemap; sources without URLs don't count. Of a listing only pages
    that are marked as articles are posts."""
    named = F.when((F.col("source") == "sitemap") & ~F.col("confirmed"), "unconfirmed-sitemap").otherwise(F.col("source"))
    rank = F.array_position(F.array(*map(F.lit, BLOG_SOURCES)), named)
    best = found.where(F.size("urls") > 0).groupBy(site).agg(F.min_by(F.struct(named.alias("source"), "urls"), F.struct(rank, F.hash("urls"))).alias("best"))
    return best.select(site, "best.source", "best.urls", (F.col("best.source") == "listing").alias("articles_only"))


def group_winner(groups: DataFrame, site: str) -> DataFrame:
    """From groups (site, name, score, urls, place) each site's best group: by score, then by URLs, then the first;
    none if even the best scores below 0. confirmed from a score of 2."""
    best = groups.groupBy(site).agg(F.max_by(F.struct("name", "score", "urls"), F.struct("score", "urls", -F.col("place"))).alias("best"))
    return best.select(site, "best.name", "best.score", "best.urls", (F.col("best.score") >= 2).alias("confirmed")).where("score >= 0")


def listing_links(pages: DataFrame, key: list[str], listing: str, links: str) -> DataFrame:
    """key, place, link: the links of each listing page to pages below it, in its order, each page once; links to
    further listings (pages, tags, authors) are left out."""
    from siteglass.functions import urls

    at, link = F.col(listing), F.col("link")
    below = F.concat(F.regexp_replace(urls.path(at), "/*$", ""), F.lit("/"))
    rows = pages.select(*key, listing, F.posexplode(links).alias("place", "link")).withColumn("link", F.regexp_replace("link", "[?#].*$", ""))
    rows = rows.where(urls.is_same_site(link, at) & urls.path(link).startswith(below) & (F.length(F.regexp_replace(urls.path(link), "/*$", "")) >= F.length(below)))
    rest = F.filter(F.split(F.lower(F.substring(urls.path(link), F.length(below) + 1, F.lit(1 << 20))), "/"), lambda s: s != "")
    rows = rows.where(~F.arrays_overlap(rest, F.array(*map(F.lit, LISTING_SEGMENTS))))
    first = rows.groupBy(*key, urls.page_key(link).alias("page_key")).agg(F.min(F.struct("place", "link")).alias("x"))
    return first.select(*key, "x.place", "x.link")


def group_score(name: str, urls: list[str], feed: set[str]) -> float:
    """How much a sitemap's group looks like the blog's: names, paths and overlap with the feed."""
    words = set(re.split("[^a-z]+", name.lower()))
    points = 3 * bool(words & {"blog", "post", "posts", "articles"}) + 2 * bool(words & {"news", "stories"}) - 3 * bool(words & {"tag", "tags", "category", "author", "product", "products", "image", "video"})
    if not urls:
        return float(points)
    in_path = sum(bool(re.search("/(blog|news|articles|posts?)/", u)) for u in urls) / len(urls)
    return points + 3 * in_path + 4 * (len(set(urls) & feed) / len(urls))


def read_incidents(text: str | None) -> list[dict]:
    """Ranking updates of a status feed, newest first; entries that lack a date are skipped."""
    try:
        data = json.loads(text or "[]")
    except ValueError:
        return []
    out = []
    for x in data if isinstance(data, list) else []:
        if isinstance(x, dict) and x.get("service_name") == "Ranking" and isinstance(x.get("begin"), str):
            title = x.get("external_desc") or ""
            kind = "core" if re.search("core update", title, re.I) else "spam" if re.search("spam update", title, re.I) else "other"
            out.append({"id": x.get("id"), "kind": kind, "title": title, "begin": x["begin"], "end": x.get("end")})
    return sorted(out, key=lambda r: r["begin"], reverse=True)


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from the head of an image file; None if it is none that is known."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", int.from_bytes(data[16:20]), int.from_bytes(data[20:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM" and len(data) >= 26:
        return "bmp", int.from_bytes(data[18:22], "little"), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:4] == b"\0\0\1\0" and len(data) >= 8:
        return "ico", data[6] or 256, data[7] or 256
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        return "webp", int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                return None
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return "jpeg", int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
            at += 2 + size
        return None
    head = data[:400].lstrip().lower()
    if b"<svg" in head:
        size = [re.search(rb"\b%s\s*=\s*[\"']([0-9.]+)" % k, head) for k in (b"width", b"height")]
        return ("svg", *(int(float(m[1])) if m else 0 for m in size))
    return None


def read_documents(df: DataFrame, reader: Callable[[str | None], object], column: str, result: str, schema: str) -> DataFrame:
    """df with `result`, the reader's answer for each text of `column`, without that column."""
    from siteglass.sources.shipping import ship

    ship(df.sparkSession)
    names = [c for c in df.columns if c not in (column, result)]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[names].copy()
            out[result] = [reader(t) for t in b["__text"]]
            yield out

    return df.select(*names, F.col(column).alias("__text")).mapInPandas(run, f"{kept}, {result} {schema}")


def compress(text: str) -> bytes:
    return gzip.compress(text.encode())
