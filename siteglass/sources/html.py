"""Pages: HTML to a nested record, in Arrow batches.

A small tree is built on the standard library's parser; void, optional and misnested tags are closed as
browsers mostly do. Everything a check asks for is read from the tree once; the rest of the engine
works on the columns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table td th tr ul body".split())
_SILENT = frozenset("script style noscript svg iframe template".split())
_HEADINGS = tuple(f"h{k}" for k in range(1, 7))
#: Elements deeper than this become siblings, as in browsers.
MOST_DEPTH = 512
#: Ancestors that a node is asked for.
_REGIONS = {"head": 1, "body": 2, "svg": 4}
_NOSNIPPET = 8
#: What an opening tag closes, besides a paragraph that a block ends.
_CLOSES = {"a": {"a"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts of a page that are not its content.
_FURNITURE_TAGS = frozenset(("nav", "aside", "footer", "form", "header"))
_FURNITURE = re.compile(r"(?:^|[\s_-])(?:nav|menu|sidebar|comments?|share|social|related|cookie|breadcrumbs?|ad|ads|advert|promo|newsletter|popup|toc)(?:$|[\s_-])", re.I)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:content|post|article|entry|main)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:sr-only|visually-hidden|screen-reader-text|hidden)(?:$|\s)", re.I)
_DENSE = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_SPACE = re.compile(r"[\s ]+")
_ARTICLE_TYPES = frozenset("Article BlogPosting NewsArticle TechArticle Report".split())
ARTICLE_FIELDS = ("headline", "image", "datePublished", "dateModified", "author")

SCHEMA = """title string, meta_description string, meta_description_gap string, meta_robots array<string>, meta_googlebot array<string>, meta_refresh string, viewport string,
canonicals array<string>, relative_canonicals array<string>, canonicals_outside_head array<string>, alternates array<struct<lang:string,href:string>>, open_graph map<string,string>,
json_ld_types array<string>, json_ld_errors int, article_fields array<string>, headline string, date_published string, date_modified string, authors array<string>,
breadcrumbs array<struct<position:int,name:string,item:string>>, website_names array<string>, logos array<string>, icons array<string>, videos int, lang string, h1s array<string>,
headings array<struct<level:int,text:string>>, first_paragraph string, images array<struct<src:string,srcset:string,alt:string,loading:string,sized:boolean>>, embeds int,
resource_urls array<string>, links array<string>, nofollow_links array<string>, uncrawlable_links array<string>, unnamed_links array<string>, render_blocking_scripts array<string>,
font_preloads_without_crossorigin array<string>, client_rendered boolean, blocks array<string>, word_count int, content_hash string, charset_declaration_end int, element_count int,
nosnippet_share double, csp_upgrades boolean, html_bytes int, featured_loading string, feeds array<string>, share_image string, share_image_as_background boolean,
declared_keywords array<string>, article_images array<string>, microdata_types array<string>"""


class Node:
    __slots__ = ("attributes", "children", "depth", "parent", "region", "tag")

    def __init__(self, tag: str, attributes: dict[str, str | None], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.depth = parent.depth + 1 if parent else 0
        # which ancestors it has, as bits, so that no question walks up again
        self.region = parent.region | _REGIONS.get(parent.tag, 0) | (_NOSNIPPET if "data-nosnippet" in parent.attributes else 0) if parent else 0

    def get(self, name: str) -> str | None:
        return self.attributes.get(name)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.children) if isinstance(x, Node)]

    def inside(self, tag: str) -> bool:
        return bool(self.region & _REGIONS[tag])

    def text(self, skip=lambda node: node.tag in _SILENT) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or not skip(x):
                if x.tag == "br" or x.tag in _BLOCK:
                    out.append(" ")
                    stack.append(" ")
                stack += reversed(x.children)
        return _SPACE.sub(" ", "".join(out)).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root
        self.beyond: list[str] = []  # open elements that are too deep to be entered

    def _close(self, tags: set[str], limits: frozenset[str] = frozenset()) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag in tags:
                self.at = node.parent
                return
            if node.tag in limits:
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self._close({"p"}, frozenset(("body", "article", "section", "div", "td")))
        if tag in _CLOSES:
            self._close(_CLOSES[tag], frozenset(("ul", "ol", "table", "dl", "select")))
        first: dict[str, str | None] = {}
        for k, v in attrs:
            first.setdefault(k, v)
        node = Node(tag, first, self.at)
        self.at.children.append(node)
        if tag in _VOID:
            return
        if node.depth < MOST_DEPTH:
            self.at = node
        else:
            self.beyond.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.beyond:
            if tag == self.beyond[-1]:
                self.beyond.pop()
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def count_words(text: str) -> int:
    """Words with a letter or digit; of scripts without spaces each character counts."""
    if text.isascii() or not _DENSE.search(text):
        words = text.split()
        plain = sum(map(str.isalnum, words))
        return plain + sum(w[0].isalnum() or any(map(str.isalnum, w)) for w in words if not w.isalnum()) if plain < len(words) else plain
    return sum(len(_DENSE.findall(w)) or any(map(str.isalnum, w)) for w in text.split())


def is_hidden(node: Node) -> bool:
    return node.tag in _SILENT or "hidden" in node.attributes or node.get("aria-hidden") == "true" or bool(_HIDDEN.search(node.get("class") or ""))


def is_furniture(node: Node) -> bool:
    return is_hidden(node) or node.tag in _FURNITURE_TAGS or bool(_FURNITURE.search(f"{node.get('class') or ''} {node.get('id') or ''}"))


def main_content(root: Node) -> Node:
    """The article with a first heading and enough of the words, else main, else a container named
    for its content, else the first article, else the body."""
    body = next((n for n in root.walk() if n.tag == "body"), root)
    words = max(1, count_words(body.text(is_hidden)))
    articles = [n for n in body.walk() if n.tag == "article"]
    for a in articles:
        if any(n.tag == "h1" for n in a.walk()) and count_words(a.text(is_hidden)) >= 0.3 * words:
            return a
    mains = [n for n in body.walk() if n.tag == "main"]
    named = [n for n in body.walk() if n.tag in ("div", "section") and _CONTENT.search(f"{n.get('class') or ''} {n.get('id') or ''}")]
    return mains[0] if mains else named[0] if len(named) == 1 else articles[0] if articles else body


def text_blocks(content: Node) -> list[str]:
    """Texts of the innermost blocks in order, without headings; loose text counts from eight words."""
    order = list(content.walk())
    holding: set[int] = set()  # nodes with a block below them: children come after parents, so from the end
    for node in reversed(order):
        if node is not content and (node.tag in _BLOCK or id(node) in holding):
            holding.add(id(node.parent))
    out: list[str] = []
    stack: list[tuple[Iterator[Node | str], list[str]]] = []

    def enter(node: Node) -> None:
        if node is not content and (is_furniture(node) or node.tag in _HEADINGS):
            return
        if id(node) in holding:
            stack.append((iter(node.children), []))
        elif count_words(text := node.text(is_hidden)):
            out.append(text)

    def end_of(loose: list[str]) -> None:
        text = _SPACE.sub(" ", " ".join(loose)).strip()
        if count_words(text) >= 8:
            out.append(text)
        loose.clear()

    enter(content)
    while stack:
        children, loose = stack[-1]
        x = next(children, None)
        if x is None:
            stack.pop()
            end_of(loose)
        elif isinstance(x, str):
            loose.append(x)
        elif x.tag in _BLOCK or id(x) in holding:
            end_of(loose)
            enter(x)
        else:
            loose.append(" " if x.tag == "br" else "" if is_hidden(x) else x.text(is_hidden))
    return out


def absolute(href: str | None, base: str) -> str | None:
    if not href:
        return None
    try:
        found = urljoin(base, href.strip())
        return found if urlsplit(found).scheme in ("http", "https") else None
    except ValueError:
        return None


def read_json_ld(text: str) -> object | None:
    """JSON that may hold raw control characters in strings; None if it is beyond that."""
    try:
        return json.loads(text, strict=False)
    except (ValueError, RecursionError):  # nested deeper than any record of a page
        return None


def ld_nodes(data: object) -> Iterator[dict]:
    """All nodes of a document: lists, @graph, mainEntity and breadcrumb are followed."""
    stack = [data]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            yield x
            stack += [x[k] for k in ("breadcrumb", "mainEntity", "@graph") if isinstance(x.get(k), dict | list)]


def _types(node: dict) -> list[str]:
    t = node.get("@type")
    return [x.rpartition("/")[2] for x in (t if isinstance(t, list) else [t]) if isinstance(x, str) and x]


def _names(value: object, by_id: dict) -> list[str]:
    out = []
    for v in value if isinstance(value, list) else [value]:
        if isinstance(v, dict):
            v = by_id.get(v["@id"], v) if "name" not in v and isinstance(v.get("@id"), str) else v
            v = v.get("name")
        if isinstance(v, str) and v.strip():
            out.append(v.strip())
    return out


def _url_of(value: object) -> str | None:
    v = value[0] if isinstance(value, list) and value else value
    if isinstance(v, dict):
        v = next((x for x in (v.get("url"), v.get("@id")) if isinstance(x, str) and x), None)
    return v if isinstance(v, str) else None


def _position(value: object) -> int | None:
    """A whole number that fits the record's type."""
    if isinstance(value, str) and re.fullmatch("[0-9]{1,9}", value.strip()):
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 31 else None


#: Types of alternates that are feeds.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json", "application/json")
_BACKGROUND = re.compile(r"background(?:-image)?\s*:[^;]*url\(\s*[\"']?([^\"')]+)")


def images_of(value: object, by_id: dict) -> list[str]:
    """The URLs of an image value: a text, a node with url or contentUrl, a reference to one, or a list of them."""
    out = []
    for v in value if isinstance(value, list) else [value]:
        if isinstance(v, dict):
            if isinstance(v.get("@id"), str) and not {"url", "contentUrl"} & v.keys():
                v = by_id.get(v["@id"], v)
            v = next((x for x in (v.get("url"), v.get("contentUrl"), v.get("@id")) if isinstance(x, str)), None)
        if isinstance(v, str) and v.strip():
            out.append(v.strip())
    return out


def _keywords(nodes: list[dict]) -> list[str]:
    """Keywords that structured data declares: lists, or texts with commas."""
    out = []
    for x in nodes:
        value = x.get("keywords")
        for v in value if isinstance(value, list) else [value]:
            out += [y.strip() for y in v.split(",") if y.strip()] if isinstance(v, str) else []
    return out


def srcset_urls(srcset: str | None) -> list[str]:
    """The URLs of a srcset: candidates are parted by commas that end a URL or follow its descriptors."""
    out, at, text = [], 0, srcset or ""
    while at < len(text):
        while at < len(text) and (text[at].isspace() or text[at] == ","):
            at += 1
        start = at
        while at < len(text) and not text[at].isspace():
            at += 1
        url = text[start:at]
        if not url:
            break
        if url.endswith(","):
            out.append(url.rstrip(","))
            continue
        out.append(url)
        depth = 0
        while at < len(text) and (text[at] != "," or depth):
            depth += (text[at] == "(") - (text[at] == ")")
            at += 1
    return [u for u in out if u]


def parse(html: str | None, url: str | None) -> dict:
    """The record of one page; null HTML is an empty page."""
    html = html or ""
    root = tree(html)
    nodes = list(root.walk())
    base = next((absolute(n.get("href"), url or "") for n in nodes if n.tag == "base" and n.get("href")), None) or url or ""
    head = [n for n in nodes if n.inside("head") or n.tag in ("title", "meta", "link") and not n.inside("body")]
    metas = [n for n in nodes if n.tag == "meta"]
    named = lambda name, among=metas: [n.get("content") or "" for n in among if (n.get("name") or "").lower() == name]
    clean = lambda s: _SPACE.sub(" ", s or "").strip()
    descriptions = [clean(x) for x in named("description")]
    rules = lambda name: [p.strip().lower() for x in named(name) for p in x.split(",") if p.strip()]
    links = [n for n in nodes if n.tag == "link"]
    rel = lambda n: (n.get("rel") or "").lower().split()
    canonical = [n for n in links if "canonical" in rel(n) and n.get("href")]
    og = {}
    for n in metas:
        if (p := n.get("property") or "").startswith(("og:", "article:")):
            og.setdefault(p, n.get("content") or "")
    blocks_ld = [read_json_ld(n.text(lambda x: False)) for n in nodes if n.tag == "script" and (n.get("type") or "").lower() == "application/ld+json"]
    ld = [x for b in blocks_ld if b is not None for x in ld_nodes(b)]
    by_id = {x["@id"]: x for x in ld if isinstance(x.get("@id"), str) and len(x) > 1}
    article = next((x for x in ld if _ARTICLE_TYPES & set(_types(x))), {})
    crumbs = next((x for x in ld if "BreadcrumbList" in _types(x)), None)
    items = crumbs.get("itemListElement") if crumbs else None
    micro = [n for n in nodes if "itemscope" in n.attributes]
    micro_article = next((n for n in micro if _ARTICLE_TYPES & {(n.get("itemtype") or "").rpartition("/")[2]}), None)
    props = {n.get("itemprop"): n for n in (micro_article.walk() if micro_article else ()) if n.get("itemprop")}
    fields = [f for f in ARTICLE_FIELDS if article.get(f) or f in props]
    h1s = [t for n in nodes if n.tag == "h1" and (t := n.text(is_hidden))]
    content = main_content(root)
    blocks = text_blocks(content)
    words = count_words(" ".join(blocks))
    anchors = [n for n in nodes if n.tag == "a" and not n.inside("head")]
    crawl, nofollow, dead, unnamed = [], [], [], []
    for a in anchors:
        href = a.get("href")
        found = absolute(href, base)
        if found is None or (href or "").strip().startswith(("#/", "#!")):
            if href is None and "onclick" in a.attributes or (href or "").lower().startswith("javascript:") or (href or "").startswith(("#/", "#!")):
                dead.append(href or a.get("onclick") or "")
            continue
        if href.strip().startswith("#"):
            continue
        crawl.append(found)
        if "nofollow" in rel(a):
            nofollow.append(found)
        if not (a.text() or a.get("aria-label") or a.get("title") or any(n.tag == "img" and n.get("alt") for n in a.walk())):
            unnamed.append(found)
    images = [n for n in nodes if n.tag == "img"]
    scripts = [n for n in head if n.tag == "script"]
    resources = [absolute(n.get(k), base) for t, k in (("script", "src"), ("img", "src"), ("iframe", "src"), ("source", "src"), ("video", "src"), ("audio", "src"), ("embed", "src"), ("object", "data")) for n in nodes if n.tag == t]
    resources += [absolute(n.get("href"), base) for n in links if {"stylesheet", "preload", "icon"} & set(rel(n))]
    resources += [absolute(u, base) for n in nodes if n.tag in ("img", "source") for u in srcset_urls(n.get("srcset"))]
    body = next((n for n in nodes if n.tag == "body"), root)
    body_words = count_words(body.text(is_hidden))
    mounts = [n for n in nodes if n.tag == "div" and n.get("id") in ("root", "app", "__next", "__nuxt")]
    asks = any(n.tag == "noscript" and re.search("enable javascript|javascript to run|requires javascript", n.text(lambda x: False), re.I) for n in nodes)
    charset = re.search(rb"<meta[^>]{0,200}charset[^>]{0,200}>", html.encode("utf-8", "replace"), re.I)
    silent = sum(count_words(n.text(is_hidden)) for n in nodes if "data-nosnippet" in n.attributes and not n.region & _NOSNIPPET)
    first = next((n.text(is_hidden) for n in content.walk() if n.tag == "p" and not is_furniture(n) and count_words(n.text(is_hidden)) >= 3), None)
    authors = _names(article.get("author"), by_id) if article else []
    authors += [clean(x) for x in named("author") if clean(x)]
    authors += [t for n in nodes if ("author" in rel(n) or n.get("itemprop") == "author" or re.search(r"(?:^|[\s_-])(?:byline|author)(?:$|[\s_-])", n.get("class") or "")) and (t := n.text(is_hidden)) and len(t) < 100]
    featured = next((n for n in content.walk() if n.tag == "img"), None)
    share = absolute(next((x for x in (og.get("og:image"), og.get("og:image:url"), *named("twitter:image")) if x and x.strip()), None), base)
    return {
        "title": next((t for n in nodes if n.tag == "title" and not n.inside("svg") and (t := clean(n.text(lambda x: False)))), None),
        "meta_description": next((d for d in descriptions if d), None),
        "meta_description_gap": None if any(descriptions) else "empty" if descriptions else "absent",
        "meta_robots": rules("robots"), "meta_googlebot": rules("googlebot"),
        "meta_refresh": next((n.get("content") for n in metas if (n.get("http-equiv") or "").lower() == "refresh"), None),
        "viewport": next(iter(named("viewport")), None),
        "canonicals": [x for n in canonical if not n.inside("body") and (x := absolute(n.get("href"), base))],
        "relative_canonicals": [n.get("href") for n in canonical if not re.match("[A-Za-z][A-Za-z0-9+.-]*:", n.get("href"))],
        "canonicals_outside_head": [n.get("href") for n in canonical if n.inside("body")],
        "alternates": [{"lang": n.get("hreflang"), "href": absolute(n.get("href"), base)} for n in links if "alternate" in rel(n) and n.get("hreflang")],
        "open_graph": og,
        "json_ld_types": list(dict.fromkeys(t for x in ld for t in _types(x))), "json_ld_errors": sum(b is None for b in blocks_ld), "article_fields": fields,
        "headline": article.get("headline") if isinstance(article.get("headline"), str) else props["headline"].text() if "headline" in props else None,
        "date_published": _date(article, "datePublished", props, og), "date_modified": _date(article, "dateModified", props, og),
        "authors": list(dict.fromkeys(authors)),
        "breadcrumbs": [{"position": _position(x.get("position")), "name": next(iter(_names(x.get("name") or x.get("item"), by_id)), None), "item": _url_of(x.get("item"))} for x in (items if isinstance(items, list) else [items]) if isinstance(x, dict)] if crumbs else None,
        "website_names": [n for x in ld if "WebSite" in _types(x) for n in _names(x.get("name"), by_id)],
        "logos": [u for x in ld if {"Organization", "Person"} & set(_types(x)) and (u := _url_of(x.get("logo")))],
        "icons": [u for n in links if "icon" in rel(n) and (u := absolute(n.get("href"), base))],
        "videos": sum(n.tag == "video" or n.tag == "iframe" and bool(re.search("youtube|vimeo", n.get("src") or "")) for n in nodes),
        "lang": next((n.get("lang") for n in nodes if n.tag == "html"), None) or None,
        "h1s": h1s,
        "headings": [{"level": int(n.tag[1]), "text": n.text(is_hidden)} for n in nodes if n.tag in _HEADINGS and not is_hidden(n)],
        "first_paragraph": first,
        "images": [{"src": absolute(n.get("src"), base), "srcset": n.get("srcset"), "alt": n.get("alt") if "alt" not in n.attributes or n.get("alt") is not None else "", "loading": n.get("loading"), "sized": bool(n.get("width") and n.get("height"))} for n in images],
        "embeds": sum(n.tag in ("iframe", "video", "embed", "object", "picture") for n in nodes),
        "resource_urls": list(dict.fromkeys(r for r in resources if r)),
        "links": list(dict.fromkeys(crawl)), "nofollow_links": list(dict.fromkeys(nofollow)), "uncrawlable_links": list(dict.fromkeys(dead)), "unnamed_links": list(dict.fromkeys(unnamed)),
        "render_blocking_scripts": [n.get("src") for n in scripts if n.get("src") and not {"async", "defer"} & n.attributes.keys() and (n.get("type") or "").lower() != "module"],
        "font_preloads_without_crossorigin": [n.get("href") or "" for n in links if "preload" in rel(n) and n.get("as") == "font" and "crossorigin" not in n.attributes],
        "client_rendered": any(not n.text() for n in mounts) or asks and body_words <= 20,
        "blocks": blocks, "word_count": words,
        "content_hash": hashlib.sha256("\n".join(blocks).encode("utf-8", "surrogatepass")).hexdigest(),
        "charset_declaration_end": charset.end() if charset else None,
        "element_count": sum(1 for _ in body.walk()) - 1,
        "nosnippet_share": silent / body_words if body_words else 0.0,
        "csp_upgrades": any((n.get("http-equiv") or "").lower() == "content-security-policy" and "upgrade-insecure-requests" in (n.get("content") or "") for n in metas),
        "html_bytes": len(html.encode("utf-8", "surrogatepass")),
        "feeds": list(dict.fromkeys(u for n in links if "alternate" in rel(n) and (n.get("type") or "").split(";")[0].strip().lower() in FEED_TYPES and (u := absolute(n.get("href"), base)))),
        "share_image": share, "share_image_as_background": share is not None and any(absolute(u, base) == share for n in content.walk() for u in _BACKGROUND.findall(n.get("style") or "")),
        "declared_keywords": list(dict.fromkeys([*_keywords(ld), *(clean(n.get("content")) for n in metas if n.get("property") == "article:tag" and clean(n.get("content")))])),
        "article_images": list(dict.fromkeys(u for x in images_of(article.get("image"), by_id) if (u := absolute(x, base)))),
        "microdata_types": list(dict.fromkeys(t for n in micro if (t := (n.get("itemtype") or "").rpartition("/")[2]))),
        "featured_loading": (featured.get("loading") or "eager") if featured is not None else None,
    }


def _date(article: dict, field: str, props: dict[str, Node], og: dict[str, str]) -> str | None:
    if isinstance(article.get(field), str):
        return article[field]
    if field in props:
        return props[field].get("datetime") or props[field].get("content") or props[field].text()
    return og.get({"datePublished": "article:published_time", "dateModified": "article:modified_time"}[field])


#: HTML of more bytes is not parsed: the fetcher would not have stored it.
MOST_BYTES = 5 << 20
TOO_LARGE = "too large"


def _sound(value: object) -> object:
    """The record without halves of surrogate pairs, which JSON may hold and no table can."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, list):
        return [_sound(x) for x in value]
    if isinstance(value, dict):
        return {_sound(k): _sound(x) for k, x in value.items()}
    return value


def parse_pages(df: DataFrame, html: str = "html", url: str = "url", fields: tuple[str, ...] | None = None) -> DataFrame:
    """df without its HTML, with `page`, the record, and `page_error`. One narrow pass. fields names those of the
    record that are asked for; null is all of them.

    Null HTML is an empty page. HTML of more than MOST_BYTES has a null record and the error TOO_LARGE; HTML
    that the parser cannot read has a null record and the name of its error.
    """
    kept = [f for f in df.schema.fields if f.name not in (html, "page", "page_error")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"page struct<{_struct(fields)}>", "page_error string"])
    names = [f.name for f in kept]

    def read(text: str | None, at: str | None, large: bool) -> tuple[dict | None, str | None]:
        if large:
            return None, TOO_LARGE
        try:
            record = parse(text, at)
            return _sound(record if fields is None else {k: record[k] for k in fields}), None
        except (AssertionError, ValueError, RecursionError) as e:  # what the standard library's parsers raise
            return None, type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            found = [read(*row) for row in zip(batch["__html"], batch["__url"], batch["__large"], strict=True)]
            out["page"], out["page_error"] = [x for x, _ in found], [x for _, x in found]
            yield out

    from siteglass.sources.shipping import ship

    ship(df.sparkSession)
    large = F.coalesce(F.octet_length(html) > MOST_BYTES, F.lit(False))
    asked = df.select(*names, F.when(~large, F.col(html)).alias("__html"), F.col(url).alias("__url"), large.alias("__large"))
    return asked.mapInPandas(run, schema)


def _struct(fields: tuple[str, ...] | None = None) -> str:
    """SCHEMA with colons, as a struct's fields are written; of the fields asked for."""
    out, depth, field = [], 0, ""
    for c in SCHEMA.replace("\n", " "):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(field)
            field = ""
        else:
            field += c
    named = [re.sub(r"^\s*(\w+) ", r"\1:", f) for f in [*out, field]]
    return ",".join(f for f in named if fields is None or f.partition(":")[0] in fields)
