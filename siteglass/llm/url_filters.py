"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over a URL's host and path together with literal tokens that any
URL it fits must hold. Each rule is filed under the one of its tokens that the fewest URLs of the
judged table hold (counted over all of them; ties: the alphabetically first). A URL is cut into
tokens once; its tokens fetch the candidate rules, and only those run. Rules without a token are
always run.

Domain rules (`net/`, `example.net/en/`) fit a host and all its subdomains whose path begins with
the rule's; the longest that fits decides. Where none fits, the pattern rules do: a fitting one
blocks (or allows) by its verdict, the first in order; else the URL is allowed.

The pattern rules are a parameter; those at hand are a list of single hosts' words and all pairs of a word
that offers and a word for what spam sells, some hundreds. Rules are compiled when first run.

A null URL and one without `://` have an empty host and path and are allowed without a rule. Hosts
are lower-cased (A-Z), paths are not. A URL of any length is judged whole; an empty table gives no rows, with
the same columns. Repeated rows are judged each; other columns pass through
unless they bear a result's name, which replaces them. Judging is narrow: no shuffle but for the
token counts, which are pre-aggregated and number at most the rules' tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteglass.llm.common import ship

RESULT = ("host", "path", "rule", "pattern", "verdict")
_TOKEN = re.compile("[A-Za-z0-9]+")
#: A rule set travels with every task, so its size is bounded.
MOST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """`literal` is the text by whose length the longest rule wins; None for a pattern rule."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    literal: str | None = None


def domain_rule(text: str, verdict: str) -> Rule:
    """`host/path`: the host or any subdomain, and paths that begin with /path."""
    host, _, rest = text.partition("/")
    path = f"/{rest}"
    # the last piece of the path may go on in the URL; it is a literal token only if it ends in a separator
    whole = path if not path[-1:].isalnum() else path.rpartition("/")[0]
    tokens = tuple(dict.fromkeys(_TOKEN.findall(host) + _TOKEN.findall(re.sub("[A-Za-z0-9]+$", "", whole))))
    return Rule(text, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, text)


def word_rule(*words: str, verdict: str = "block") -> Rule:
    """The words in that order as whole tokens of the host, one separator between them."""
    inner = "[._-]".join(re.escape(w) for w in words)
    return Rule("-".join(words), verdict, rf"(?:[^/]*[._-])?{inner}(?:[._:-][^/]*)?(?:/|$)", tuple(words))


#: Fixed values of the contract.
DOMAIN_RULES = (
    domain_rule("net/", "block"),
    domain_rule("example.net/en/", "allow"),
    domain_rule("example.com/de/", "block"),
    domain_rule("org/fr/", "allow"),
)
#: Hosts that sell or advertise rather than say something.
OFFERS = ("buy", "cheap", "cheapest", "discount", "discounted", "free", "get", "instant", "order", "quick", "top", "win", "easy", "fast", "online", "best")
GOODS = (
    "backlinks", "bets", "bitcoins", "bonus", "botox", "casino", "casinos", "cialis", "coupons", "credits", "diploma", "diplomas", "essays", "fakes", "followers", "gambling", "gems", "giveaway", "hookups",
    "jackpot", "jackpots", "likes", "loans", "lottery", "meds", "pills", "poker", "porn", "rolex", "roulette", "slots", "spins", "steroids", "tramadol", "viagra", "watches", "weightloss", "xanax",
)
PATTERN_RULES = (
    word_rule("spam", "farm"),
    word_rule("link", "farm"),
    word_rule("cheap", "pills"),
    word_rule("casino"),
    word_rule("viagra"),
    word_rule("payday", "loans"),
    word_rule("replica", "watches"),
    word_rule("adserver"),
    word_rule("doubleclick"),
    word_rule("clickbait"),
    *(word_rule(offer, goods) for offer in OFFERS for goods in GOODS),
)


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL's host and path, natively; lower-case forms too."""
    rest = F.regexp_extract(url, "(?s)^.*?://([^?#]*)", 1)
    found = F.regexp_extract_all(rest, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.array_union(found, F.transform(found, F.lower))


def token_counts(df: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, int]:
    """In how many URLs each token of the rules occurs; at most one number for each such token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    held = F.array_intersect(tokens_of(F.col(url)), F.array(*map(F.lit, wanted)))
    counted = df.where(F.col(url).isNotNull()).select(F.explode(held).alias("token")).groupBy("token").count()
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in counted.collect()}


def index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by the token they are filed under; "" holds those without any."""
    out: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(k)
    return out


def judge_url(url: str | None, rules: list[Rule], by_token: dict[str, list[int]], compiled: Callable[[str], re.Pattern]) -> tuple[str, str, str | None, str | None, str]:
    host, path = host_and_path(url)
    whole = host + path
    found = _TOKEN.findall(whole)
    candidates = set(by_token.get("", ()))
    for t in {*found, *map(str.lower, found)} if whole else ():
        candidates.update(by_token.get(t, ()))
    best = pattern = None
    for k in sorted(candidates):
        r = rules[k]
        if whole and compiled(r.regex).match(whole):
            if r.literal is None:
                pattern = pattern or r
            elif best is None or len(r.literal) > len(best.literal):
                best = r
    verdict = best.verdict if best else pattern.verdict if pattern else "allow"
    return host, path, best.name if best else None, None if best or not pattern else pattern.name, verdict


def judge(df: DataFrame, rules: tuple[Rule, ...] = DOMAIN_RULES + PATTERN_RULES, url: str = "url") -> DataFrame:
    """df with host, path, rule, pattern and verdict."""
    ship(df.sparkSession)
    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: split the set and judge in turns")
    by_token = index(rules, token_counts(df, rules, url))
    kept = [f for f in df.schema.fields if f.name not in RESULT]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(n, T.StringType()) for n in RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = cache(lambda regex: re.compile(regex, re.S))
        for batch in batches:
            urls = batch.column(batch.num_columns - 1).to_pylist()
            rows = [judge_url(u, rules, by_token, compiled) for u in urls]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(RESULT)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.string()) for c in columns)], names=[*names, *RESULT])

    return df.select(*names, F.col(url).alias("__url")).mapInArrow(run, schema)


def sql(table: str = "pages") -> str:
    """The same judgement in SQL, all rules run on all URLs."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    domain = sorted((r for r in DOMAIN_RULES), key=lambda r: -len(r.literal))
    fits = {r.name: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')" for r in domain for h, _, p in [r.name.partition("/")]}
    rule = "CASE " + " ".join(f"WHEN {fits[r.name]} THEN '{r.name}'" for r in domain) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in domain)
    verdict += " " + " ".join(f"WHEN regexp_matches(whole, '^(?:{r.regex})', 's') THEN '{r.verdict}'" for r in PATTERN_RULES) + " ELSE 'allow' END"
    pattern = "CASE WHEN rule IS NOT NULL THEN NULL " + " ".join(f"WHEN regexp_matches(whole, '^(?:{r.regex})', 's') THEN '{r.name}'" for r in PATTERN_RULES) + " END"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {table}),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{upper}', '{lower}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, host || path AS whole, {rule} AS rule FROM c)
SELECT page_id, host, path, rule, {pattern} AS pattern, {verdict} AS verdict FROM d"""
