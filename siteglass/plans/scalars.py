"""A query for each scalar function: a key, and the function over a table's column."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteglass.functions import bands, texts, times, urls
from siteglass.operators import ranks
from siteglass.plans import model as m
from siteglass.plans.registry import query


def _register(name: str, table: str, key: str, column, sql: str, where: str = "true") -> None:
    @query(name, f"SELECT {key} AS key, {sql} AS value FROM {table} WHERE {where}", prelude=False)
    def run(spark, sf_dir):
        return m.table(spark, sf_dir, table).where(where).select(F.col(key).alias("key"), column().alias("value"))


def c(name: str):
    return F.col(name)


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SITE = f"regexp_replace({_HOST}, '^www\\.', '')"
_SEARCH = "regexp_extract(url, '^[^?#]*([?][^#]*)', 1)"
_BARE = "regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')"

_register("fn_site_key", "pages", "page_id", lambda: urls.site_key(c("url")), _SITE)
_register("fn_is_same_site", "pages", "page_id", lambda: urls.is_same_site(c("url"), F.lit("https://WWW.therat.example.net/x")), f"{_SITE} = 'therat.example.net'")
_register("fn_same_document", "pages", "page_id", lambda: urls.is_same_document(c("url"), F.concat(c("url"), F.lit("/#a"))), f"{_BARE} = regexp_replace(regexp_replace(url || '/#a', '#.*$', ''), '/+$', '')")
_register("fn_page_key", "pages", "page_id", lambda: urls.page_key(c("url")), f"{_SITE} || regexp_replace({_PATH}, '/+$', '') || {_SEARCH}")
_register("fn_group_key", "pages", "page_id", lambda: urls.group_key(c("url")), "regexp_replace(url, '[-_]?[0-9]+([.][a-z]+)?$', '\\1')")
_register("fn_strip_tracking", "pages", "page_id", lambda: urls.strip_tracking(c("url")), "regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_[A-Za-z0-9_]*=[^&]*&', '?', 'g'), '[?&]utm_[A-Za-z0-9_]*=[^&]*', '', 'g')")
_register("fn_http_twin", "pages", "page_id", lambda: urls.is_http_twin(c("url"), F.regexp_replace(c("url"), "^http:", "https:")), "starts_with(url, 'http:')")
_register("fn_link_variants", "pages", "page_id", lambda: F.array_join(urls.link_variants(c("url"), F.lit("https://therat.example.net/a")), ","), f"array_to_string(list_filter([CASE WHEN starts_with(url, 'http:') THEN 'http' END, CASE WHEN {_HOST} <> 'therat.example.net' AND {_SITE} = 'therat.example.net' THEN 'host' END, CASE WHEN regexp_matches(url, '[?&]utm_[A-Za-z0-9_]*=') THEN 'tracking' END], lambda x: x IS NOT NULL), ',')")
_register("fn_is_dev_host", "pages", "page_id", lambda: urls.is_dev_host(F.when(c("page_id") % 2 == 0, F.regexp_replace(c("url"), "://", "://staging.")).otherwise(c("url"))), "page_id % 2 = 0")
_register("fn_organisation_of", "pages", "page_id", lambda: urls.organisation(c("url")), f"array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.')")
_register("fn_parse_website", "pages", "page_id", lambda: urls.parse_website(F.regexp_replace(c("url"), "^https?://", "")), f"'https://' || {_HOST}")
_register("fn_file_name", "pages", "page_id", lambda: urls.file_name(c("url")), f"string_split({_PATH}, '/')[-1]")
_register("fn_stem", "pages", "page_id", lambda: urls.stem(c("url")), f"regexp_replace(regexp_replace(string_split({_PATH}, '/')[-1], '[.][A-Za-z0-9]+$', ''), '-[0-9]+x[0-9]+$', '')")
_register("fn_extension", "pages", "page_id", lambda: urls.extension(c("url")), f"lower(regexp_extract(string_split({_PATH}, '/')[-1], '[.]([A-Za-z0-9]+)$', 1))")
_FIRST = f"regexp_extract(lower({_PATH}), '^/*([^/]+)', 1)"
_SECTIONS = "('refer', 'go', 'goto', 'out', 'recommends', 'visit', 'aff', 'affiliate')"
#: Pages under sections and segments that the rules ask for, so that both answers occur.
_ODD_URL = "regexp_replace(url, '^([a-z]+://[^/]+)', '\\1' || CASE page_id % 5 WHEN 0 THEN '/go' WHEN 1 THEN '/x/wprm_print' WHEN 2 THEN '/Cart' WHEN 3 THEN '/printing' ELSE '' END)"


def odd_url():
    section = F.when(c("page_id") % 5 == 0, "/go").when(c("page_id") % 5 == 1, "/x/wprm_print").when(c("page_id") % 5 == 2, "/Cart").when(c("page_id") % 5 == 3, "/printing").otherwise("")
    host = F.regexp_extract(c("url"), "^[a-z]+://[^/]+", 0)
    return F.concat(host, section, F.substring(c("url"), F.length(host) + 1, F.lit(1 << 20)))


_ODD_PATH = f"lower(regexp_extract({_ODD_URL}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
_ODD_FIRST = f"regexp_extract({_ODD_PATH}, '^/*([^/]+)', 1)"
_register("fn_own_page", "pages", "page_id", lambda: urls.is_own_page(odd_url()), f"NOT ({_ODD_FIRST} IN {_SECTIONS} OR regexp_matches({_ODD_PATH}, '(^|[/_-])print($|[/_-])'))")
_register("fn_outbound_redirect", "pages", "page_id", lambda: urls.is_outbound_redirect(odd_url()), f"{_ODD_FIRST} IN {_SECTIONS}")
_register("fn_action_link", "pages", "page_id", lambda: urls.is_action_link(odd_url()), f"list_has_any(string_split({_ODD_PATH}, '/'), ['cart', 'basket', 'checkout', 'login', 'logout', 'signin', 'signout', 'wp-login.php'])")
_register("fn_logo_kind", "pages", "page_id", lambda: urls.logo_kind(F.concat(F.lit("https://a.test/i/"), F.when(c("page_id") % 3 == 0, "site_logo.png").when(c("page_id") % 3 == 1, "brand.svg?v=2").otherwise("new-logo-reveal-2026.jpg")), F.array(F.lit("/i/brand.svg"), F.lit("https://b.test/x.png")), F.lit("https://a.test/p")), "CASE page_id % 3 WHEN 0 THEN 'named' WHEN 1 THEN 'declared' END")
_OCTETS = "event_id % 256 AS a, (event_id // 7) % 256 AS b"
_register("fn_public_address", "events", "event_id", lambda: urls.is_public_address(F.concat(F.when(c("event_id") % 2 == 0, "::ffff:").otherwise(""), F.concat_ws(".", (c("event_id") % 256).cast("string"), (F.floor(c("event_id") / 7) % 256).cast("string"), F.lit("3"), F.lit("4")))),
          "NOT (event_id % 256 IN (0, 10, 127) OR event_id % 256 >= 224 OR (event_id % 256 = 100 AND (event_id // 7) % 256 BETWEEN 64 AND 127) OR (event_id % 256 = 169 AND (event_id // 7) % 256 = 254) OR (event_id % 256 = 172 AND (event_id // 7) % 256 BETWEEN 16 AND 31) OR (event_id % 256 = 192 AND (event_id // 7) % 256 = 168))")
_register("fn_fnv1a32", "pages", "page_id", lambda: ranks.fnv1a32(c("url")), "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, strlen(url) + 1), lambda i: ('0x' || substr(hex(url::BLOB), CAST(2 * i - 1 AS INT), 2))::HUGEINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT")
_M = "((({a}) & 65535) * ({b}) + (((({a}) >> 16) * ({b})) & 65535) * 65536) & 4294967295"
_register("fn_mulberry32", "events", "event_id", lambda: F.round(ranks.mulberry32(c("event_id") * 2654435 % (1 << 32)), 12),
          "(SELECT round(xor(u, u >> 14) / 4294967296.0, 12) FROM (SELECT xor(t, (t + " + _M.format(a="xor(t, t >> 7)", b="t | 61") + ") & 4294967295) AS u FROM (SELECT " + _M.format(a="xor(s, s >> 15)", b="s | 1") + " AS t FROM (SELECT (event_id * 2654435 % 4294967296 + 1831565813) & 4294967295 AS s))))")

_COLLAPSED = "trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g'))"
_TOKENS = f"string_split({_COLLAPSED}, ' ')"
_register("fn_collapse", "documents", "doc_id", lambda: F.md5(texts.collapse(c("text"))), f"md5({_COLLAPSED})")
_register("fn_word_count", "documents", "doc_id", lambda: texts.word_count(c("text")), f"len(list_filter({_TOKENS}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')))")
_register("fn_char_length", "documents", "doc_id", lambda: F.length("text"), "length(text)")
_register("fn_clip", "documents", "doc_id", lambda: texts.clip(F.concat(F.lit("a🙂🙂"), F.coalesce(c("text"), F.lit("")), F.lit("x" * 9)), 4), "'a🙂'")
_register("fn_content_hash", "documents", "doc_id", lambda: texts.content_hash(c("text")), "sha256(text)")
_register("fn_iso_language", "documents", "doc_id", lambda: texts.iso_language(F.concat(c("lang"), F.lit("_XX"))), "lower(lang)")
_register("fn_is_weak_token", "part", "p_partkey", lambda: texts.is_weak_token(F.get(F.split("p_name", " "), 0)), "length(string_split(p_name, ' ')[1]) < 2 OR regexp_matches(string_split(p_name, ' ')[1], '^[0-9]+$')")
_register("fn_title_segments", "part", "p_partkey", lambda: F.array_join(texts.title_segments(F.concat("p_name", F.lit(" - "), "p_brand", F.lit(" | "), "p_type")), "/"), "array_to_string([trim(p_name), trim(p_brand), trim(p_type)], '/')")
_register("fn_ngrams", "part", "p_partkey", lambda: F.size(texts.ngrams(F.split("p_type", " "), 2)), "2 * len(string_split(p_type, ' ')) - 1")


@query("fn_shingles", f"SELECT doc_id AS key, len(list_distinct(list_transform(range(1, greatest(1, len(ws) - 3)), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')))) AS value FROM (SELECT doc_id, {_TOKENS} AS ws FROM documents)", prelude=False)
def fn_shingles(spark, sf_dir):
    """The tokens are a column of their own, so that they are cut once and not for each shingle."""
    cut = m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.split(texts.collapse(c("text")), " ").alias("tokens"))
    return cut.select("key", F.size(texts.shingles(F.col("tokens"))).alias("value"))


_register("fn_jaccard", "part", "p_partkey", lambda: F.round(texts.jaccard(F.array_distinct(F.split("p_name", " ")), F.array_distinct(F.split("p_type", " "))), 9), "round(len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' '))) / len(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' '))))::DOUBLE, 9)")
_register("fn_normalize_text", "part", "p_partkey", lambda: texts.normalised(F.concat("p_name", F.lit("’s ﬁne Ｆｕｌｌ x² e\u0301te\u0301 — l’été DON'T")), whole=True), "trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' fine full x2 été été don'")
_register("fn_clause_shaped", "part", "p_partkey", lambda: texts.clause_shaped(F.concat(c("p_name"), F.when(c("p_partkey") % 2 == 0, " is").otherwise(""))), "p_partkey % 2 = 0")
_register("fn_letters_by_script", "documents", "doc_id", lambda: texts.letters_by_script(c("text"))["latin"], "length(text) - length(regexp_replace(text, '\\p{Latin}', '', 'g'))")

_register("fn_is_iso_day", "events", "event_id", lambda: times.is_iso_day(F.concat(F.date_format("ts", "yyyy-MM-"), F.lpad((c("event_id") % 40).cast("string"), 2, "0"))), "event_id % 40 BETWEEN 1 AND 31")
_register("fn_add_days", "events", "event_id", lambda: times.add_days(F.to_date("ts"), 40), "CAST(CAST(ts AS DATE) + 40 AS DATE)")
_register("fn_days_between", "events", "event_id", lambda: times.days_between(F.lit("2023-12-25").cast("date"), F.to_date("ts")), "date_diff('day', DATE '2023-12-25', CAST(ts AS DATE)) + 1")
_register("fn_day_in_zone", "events", "event_id", lambda: times.day_in_zone(c("ts"), "Asia/Tokyo"), "CAST(ts + INTERVAL 9 HOUR AS DATE)")
_register("fn_day_range_to_utc", "events", "event_id", lambda: times.day_range_to_utc(F.to_date("ts"), F.to_date("ts"), "Europe/Kyiv")[1].cast("timestamp_ntz"), "CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) - INTERVAL 2 HOUR")
_register("fn_today_in_zone", "events", "event_id", lambda: times.today_in_zone(c("ts"), "Asia/Kolkata"), "CAST(ts + INTERVAL 330 MINUTE AS DATE)")
_register("fn_is_time_zone", "nation", "n_nationkey", lambda: times.is_time_zone(F.when(c("n_nationkey") % 3 == 0, "Europe/Kyiv").when(c("n_nationkey") % 3 == 1, c("n_name")).otherwise("UTC")), "n_nationkey % 3 <> 1 OR n_name IN ('EGYPT', 'IRAN', 'JAPAN')")
_ISO_TEXT = "strftime(ts, '%Y-%m-') || lpad((event_id % 34)::VARCHAR, 2, '0') || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'T10:30:05,25+05' ELSE 'T25:00Z' END"


def iso_text():
    day = F.concat(F.date_format("ts", "yyyy-MM-"), F.lpad((c("event_id") % 34).cast("string"), 2, "0"))
    return F.concat(day, F.when(c("event_id") % 3 == 0, "").when(c("event_id") % 3 == 1, "T10:30:05,25+05").otherwise("T25:00Z"))


_ISO_DAY = f"try_cast(left({_ISO_TEXT}, 10) AS DATE)"
_ISO_MS = f"CASE WHEN event_id % 3 < 2 THEN epoch_ms(CAST({_ISO_DAY} AS TIMESTAMP)) + CASE event_id % 3 WHEN 1 THEN 37805250 - 18000000 ELSE 0 END END"
_register("fn_read_iso_date", "events", "event_id", lambda: F.concat_ws("/", *(times.read_iso_date(iso_text())[x].cast("string") for x in ("epoch_ms", "has_time", "has_zone"))), f"CASE WHEN ({_ISO_MS}) IS NULL THEN '' ELSE ({_ISO_MS})::VARCHAR || CASE event_id % 3 WHEN 1 THEN '/true/true' ELSE '/false/false' END END")
_register("fn_instant_of", "events", "event_id", lambda: times.instant_of(F.when(c("event_id") % 2 == 0, iso_text()).otherwise(F.date_format("ts", "MMMM d, yyyy"))), f"CASE WHEN event_id % 2 = 1 THEN epoch_ms(date_trunc('day', ts)) ELSE {_ISO_MS} END")
_TODAY = "DATE '2024-02-01'"
_register("fn_resolve_history_range", "events", "event_id",
          lambda: F.concat_ws("/", *(times.history_range(F.when(c("event_id") % 4 == 0, F.date_sub(F.to_date("ts"), (c("event_id") % 500).cast("int"))), F.when(c("event_id") % 3 > 0, F.to_date("ts")), F.lit("2024-02-01").cast("date"))[x].cast("string") for x in ("from", "to"))),
          f"(SELECT CASE WHEN f <= t AND date_diff('day', f, t) < 366 THEN f::VARCHAR || '/' || t::VARCHAR ELSE '' END FROM (SELECT t, CASE WHEN event_id % 4 = 0 THEN CAST(ts AS DATE) - CAST(event_id % 500 AS INTEGER) ELSE t - 29 END AS f FROM (SELECT least(CASE WHEN event_id % 3 > 0 THEN CAST(ts AS DATE) ELSE {_TODAY} END, {_TODAY}) AS t)))")
_register("fn_resolve_range_ui", "events", "event_id",
          lambda: F.concat_ws("/", *(times.preset_range(F.get(F.array(*map(F.lit, ("7d", "30d", "90d", "12m", "custom"))), (c("event_id") % 5).cast("int")), F.when(c("event_id") % 2 == 0, F.to_date("ts")), F.lit("2024-01-10").cast("date"), F.lit("2024-02-01").cast("date"))[x].cast("string") for x in ("from", "to"))),
          f"CASE WHEN event_id % 10 = 4 THEN least(CAST(ts AS DATE), DATE '2024-01-10')::VARCHAR || '/' || greatest(CAST(ts AS DATE), DATE '2024-01-10')::VARCHAR ELSE ({_TODAY} - CASE event_id % 5 WHEN 0 THEN 6 WHEN 2 THEN 89 WHEN 3 THEN 364 ELSE 29 END)::VARCHAR || '/' || ({_TODAY})::VARCHAR END")
_register("fn_latest_capture", "events", "event_id", lambda: times.latest_capture(c("ts")).cast("timestamp_ntz"), "CASE WHEN hour(ts) >= 12 THEN date_trunc('day', ts) + INTERVAL 12 HOUR ELSE date_trunc('day', ts) - INTERVAL 12 HOUR END")
_register("fn_history_days", "part", "p_partkey", lambda: times.history_days(c("p_size")), "greatest(365, CAST(ceil(50000 / p_size::DOUBLE) AS BIGINT))")
_register("fn_retry_delay", "part", "p_partkey", lambda: times.retry_delay(c("p_size") % 5 + 1), "CAST(60 * pow(4, p_size % 5) AS BIGINT)")

_register("fn_cwv_band", "supplier", "s_suppkey", lambda: bands.vital_band("lcp", c("s_acctbal")), "CASE WHEN s_acctbal <= 2500 THEN 'good' WHEN s_acctbal <= 4000 THEN 'needsImprovement' ELSE 'poor' END")
_register("fn_score_band", "part", "p_partkey", lambda: bands.score_band(c("p_size") * 2), "CASE WHEN p_size * 2 <= 49 THEN 'poor' WHEN p_size * 2 <= 89 THEN 'average' ELSE 'good' END")
_register("fn_position_bucket", "part", "p_partkey", lambda: bands.position_bucket(c("p_size")), "CASE WHEN p_size <= 3 THEN 'top3' WHEN p_size <= 10 THEN 'top10' WHEN p_size <= 20 THEN 'top20' ELSE 'below' END")
_register("fn_severity_weight", "lineitem", "l_orderkey", lambda: bands.severity_weight(m.severity(c("l_returnflag"))), "CASE l_returnflag WHEN 'R' THEN 10 WHEN 'A' THEN 3 ELSE 1 END")
_register("fn_page_score_raw", "part", "p_partkey", lambda: bands.page_score(F.lit(60), c("p_size")), "CAST(floor(100.0 * (60 - p_size) / 60 + 0.5) AS BIGINT)")
_register("fn_baseline", "part", "p_partkey", lambda: bands.baseline(c("p_size") / 50.0, F.lit(0.25)), "CAST(greatest(1, least(100, floor(3 + pow(1 - p_size / 50.0, 1.5) * 85 + 3 + 0.5))) AS BIGINT)")
_register("fn_idf", "part", "p_partkey", lambda: F.round(bands.idf(F.lit(60), c("p_size"), F.lit(True)), 9), "round(CASE WHEN p_size <= 9 THEN 1 - 0.5 * (1 - ln(1 + 60 / p_size::DOUBLE) / ln(61)) ELSE ln(1 + 60 / p_size::DOUBLE) / ln(61) END, 9)")
_register("fn_keyword_budget", "documents", "doc_id", lambda: bands.keyword_budget(c("n_chars")), "greatest(1, least(6, 2 + n_chars // 400))")
_register("fn_unscale_cls", "part", "p_partkey", lambda: bands.unscaled_cls(c("p_size"), c("p_size") % 3), "CASE WHEN p_size % 3 <= 1 THEN p_size::DOUBLE ELSE p_size / 100::DOUBLE END")
_register("fn_round_digits", "part", "p_partkey", lambda: F.round(c("p_retailprice") / 7, 4), "round(p_retailprice / 7, 4)")
_register("fn_array_is_clean", "part", "p_partkey", lambda: texts.is_clean(F.when(c("p_partkey") % 4 == 0, F.array_append(F.split("p_name", " "), F.lit(None).cast("string"))).when(c("p_partkey") % 4 == 1, F.array_append(F.split("p_name", " "), F.lit(""))).when(c("p_partkey") % 4 == 2, F.split("p_name", " "))), "CASE p_partkey % 4 WHEN 2 THEN len(list_distinct(string_split(p_name, ' '))) = len(string_split(p_name, ' ')) WHEN 3 THEN NULL ELSE false END")
_register("fn_cardinality", "part", "p_partkey", lambda: F.size(F.split("p_type", " ")), "len(string_split(p_type, ' '))")
_register("fn_jsonb_get_dyn", "events", "event_id", lambda: F.from_json("props", "map<string,int>")[F.when(c("event_id") % 2 == 0, "k").otherwise("none")], "CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END")
