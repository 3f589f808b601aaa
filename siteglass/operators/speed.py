"""Page-speed answers: JSON to measured vitals, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.functions import bands

_METRIC = "struct<percentile:double,distributions:array<struct<min:double,max:double,proportion:double>>>"
_FIELD = f"metrics:struct<LARGEST_CONTENTFUL_PAINT_MS:{_METRIC},INTERACTION_TO_NEXT_PAINT:{_METRIC},CUMULATIVE_LAYOUT_SHIFT_SCORE:{_METRIC},EXPERIMENTAL_TIME_TO_FIRST_BYTE:{_METRIC}>"
SCHEMA = f"""struct<loadingExperience:struct<{_FIELD},origin_fallback:boolean>,originLoadingExperience:struct<{_FIELD}>,
lighthouseResult:struct<audits:map<string,struct<score:double,scoreDisplayMode:string,numericValue:double,details:struct<overallSavingsBytes:double,items:array<struct<url:string,totalBytes:double,wastedBytes:double,type:string,selector:string,snippet:string,items:array<struct<subpart:string,duration:double>>>>>>>,categories:struct<performance:struct<score:double>,seo:struct<score:double>,accessibility:struct<score:double>>,runtimeError:struct<code:string>>,
error:struct<code:int,message:string,errors:array<struct<reason:string>>>>""".replace("\n", "")
#: Metric: its name in field data and its audit in lab data; INP has no lab value.
METRICS = {
    "lcp": ("LARGEST_CONTENTFUL_PAINT_MS", "largest-contentful-paint"),
    "inp": ("INTERACTION_TO_NEXT_PAINT", None),
    "cls": ("CUMULATIVE_LAYOUT_SHIFT_SCORE", "cumulative-layout-shift"),
    "ttfb": ("EXPERIMENTAL_TIME_TO_FIRST_BYTE", "server-response-time"),
}
SEO_AUDITS = ("is-crawlable", "document-title", "meta-description", "http-status-code", "link-text", "crawlable-anchors", "robots-txt", "hreflang", "canonical", "image-alt")
LEAST_SAVING = 102_400


def parsed(df: DataFrame, body: str = "body") -> DataFrame:
    return df.withColumn("a", F.from_json(body, SCHEMA))


def classify(status: Column) -> Column:
    """measured, rateLimited, keyRejected, transient or permanent, asked in that order of precedence."""
    reasons = F.transform(F.col("a.error.errors"), lambda e: e["reason"])
    has = lambda *names: F.coalesce(F.arrays_overlap(reasons, F.array(*map(F.lit, names))), F.lit(False))
    runtime = F.col("a.lighthouseResult.runtimeError.code").isNotNull()
    return (
        F.when((status == 429) | has("rateLimitExceeded", "quotaExceeded"), "rateLimited")
        .when(has("keyInvalid", "forbidden") | (status == 403), "keyRejected")
        .when((status == 200) & F.col("a.lighthouseResult").isNotNull() & ~runtime, "measured")
        .when((status >= 500) | (status == 0) | runtime, "transient")
        .otherwise("permanent")
    )


def _field(where: str, metric: str) -> Column:
    m = F.col(f"a.{where}.metrics.{METRICS[metric][0]}")
    value = m["percentile"]
    return bands.unscaled_cls(value, F.get(m["distributions"], 0)["max"]) if metric == "cls" else value


def reading(metric: str) -> Column:
    """struct(value, source): the page's own field data, else its origin's, else the lab's."""
    fallback = F.coalesce(F.col("a.loadingExperience.origin_fallback"), F.lit(False))
    own, origin = _field("loadingExperience", metric), _field("originLoadingExperience", metric)
    audit = METRICS[metric][1]
    lab = F.col("a.lighthouseResult.audits")[audit]["numericValue"] if audit else F.lit(None).cast("double")
    make = lambda v, s: F.when(v.isNotNull(), F.struct(F.round(v, 4).alias("value"), F.lit(s).alias("source")))
    return F.coalesce(make(F.when(~fallback, own), "url"), make(F.coalesce(F.when(fallback, own), origin), "origin"), make(lab, "lab"))


def visit_shares(metric: str) -> Column:
    """Good and poor shares of visits, from exactly three bands."""
    d = F.col(f"a.loadingExperience.metrics.{METRICS[metric][0]}.distributions")
    return F.when(F.size(d) == 3, F.struct(F.get(d, 0)["proportion"].alias("good"), F.get(d, 2)["proportion"].alias("poor")))


def measure(df: DataFrame) -> DataFrame:
    """df (with a, the parsed answer) with lcp, inp, cls, ttfb (value, source, band), score, seo_score,
    lighthouse_judged, lighthouse_failed, image_saving; measured needs LCP, CLS and the score."""
    out = df
    for m in METRICS:
        r = reading(m)
        out = out.withColumn(m, F.when(r.isNotNull(), F.struct(r["value"].alias("value"), r["source"].alias("source"), bands.vital_band(m, r["value"]).alias("band"))))
    share = lambda c: F.floor(F.col(f"a.lighthouseResult.categories.{c}.score") * 100 + 0.5).cast("int")
    audits = F.col("a.lighthouseResult.audits")
    judged = F.filter(F.array(*map(F.lit, SEO_AUDITS)), lambda k: (audits[k]["scoreDisplayMode"] == "binary") & audits[k]["score"].isin(0.0, 1.0))
    saving = F.aggregate(F.map_values(audits), F.lit(0.0), lambda a, x: F.greatest(a, F.coalesce(x["details"]["overallSavingsBytes"], F.lit(0.0))))
    out = out.withColumn("score", share("performance")).withColumn("seo_score", share("seo"))
    out = out.withColumn("lighthouse_judged", judged).withColumn("lighthouse_failed", F.filter(judged, lambda k: audits[k]["score"] == 0.0))
    out = out.withColumn("image_saving", F.when(saving >= LEAST_SAVING, saving))
    return out.withColumn("measured", F.col("lcp").isNotNull() & F.col("cls").isNotNull() & F.col("score").isNotNull())


def vital_issues(measured: DataFrame, key: str) -> DataFrame:
    """A row for each metric outside good: key, metric, band, value."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.band").alias("band"), F.col(f"{m}.value").alias("value")) for m in ("lcp", "inp", "cls")])
    return measured.select(key, F.explode(rows).alias("x")).where("x.band is not null and x.band != 'good'").select(key, "x.*")


#: The phases of a largest paint in order, and the audits that hold them and the images.
LCP_PHASES = ("timeToFirstByte", "resourceLoadDelay", "resourceLoadDuration", "elementRenderDelay")
BREAKDOWN_AUDIT, IMAGES_AUDIT = "lcp-breakdown-insight", "image-delivery-insight"
MOST_IMAGES = 10
#: Audits that are told of beside the score, where they fail.
DIAGNOSTICS = ("render-blocking-insight", "unused-javascript", "unused-css-rules", "font-display-insight", "dom-size-insight", "cache-insight", "legacy-javascript-insight")


def _items(audit: str) -> Column:
    return F.col("a.lighthouseResult.audits")[audit]["details"]["items"]


def lcp_breakdown() -> Column:
    """struct(selector, snippet, phases): the phases of the largest paint in the order they happen, none below 0;
    null without any."""
    items = F.coalesce(_items(BREAKDOWN_AUDIT), F.array().cast("array<struct<url:string,totalBytes:double,wastedBytes:double,type:string,selector:string,snippet:string,items:array<struct<subpart:string,duration:double>>>>"))
    table = F.get(F.filter(items, lambda x: x["items"].isNotNull()), F.lit(0))["items"]
    node = F.get(F.filter(items, lambda x: (x["type"] == "node") & x["selector"].isNotNull() & x["snippet"].isNotNull()), F.lit(0))
    named = F.transform(F.array(*map(F.lit, LCP_PHASES)), lambda p: F.struct(p.alias("phase"), F.get(F.filter(table, lambda r: r["subpart"] == p), F.lit(0))["duration"].alias("ms")))
    phases = F.transform(F.filter(named, lambda x: x["ms"].isNotNull()), lambda x: F.struct(x["phase"].alias("phase"), F.greatest(F.lit(0), F.floor(x["ms"] + 0.5)).cast("long").alias("ms")))
    return F.when(F.size(phases) > 0, F.struct(node["selector"].alias("selector"), node["snippet"].alias("snippet"), phases.alias("phases")))


def heaviest_images() -> Column:
    """The images of an answer by the bytes they waste, MOST_IMAGES of them; ties by URL."""
    rows = F.filter(_items(IMAGES_AUDIT), lambda x: x["url"].isNotNull() & (x["wastedBytes"] > 0))
    ranked = F.array_sort(F.transform(rows, lambda x: F.struct((-x["wastedBytes"]).alias("less"), x["url"].alias("url"), x["totalBytes"].alias("total_bytes"), x["wastedBytes"].alias("wasted_bytes"))))
    return F.transform(F.slice(ranked, 1, MOST_IMAGES), lambda x: F.struct(x["url"].alias("url"), x["total_bytes"].alias("total_bytes"), x["wasted_bytes"].alias("wasted_bytes")))


def diagnostics() -> Column:
    """The diagnostic audits that an answer fails, in the catalogue's order."""
    audits = F.col("a.lighthouseResult.audits")
    return F.filter(F.array(*map(F.lit, DIAGNOSTICS)), lambda k: F.coalesce(audits[k]["score"] < 0.9, F.lit(False)))


def owners() -> list[tuple[str, str]]:
    """(code, owner) of all findings: each code has one writer, which alone may replace its rows."""
    from siteglass.operators import checks

    return [*((x.code, "crawl") for x in checks.CATALOGUE), *((f"LIGHTHOUSE_{k.replace('-', '_').upper()}", "lighthouse") for k in SEO_AUDITS), *((f"{k.upper()}_NOT_GOOD", "vitals") for k in METRICS)]
