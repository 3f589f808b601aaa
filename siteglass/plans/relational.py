"""Read models: filters, joins, aggregates, windows and ordered slices, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteglass.plans import model as m
from siteglass.plans.registry import query

#: The instant that queue queries take as the present.
NOW = "1998-06-01 00:00:00"


def escape_like(text: str) -> str:
    """text as a literal inside a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


@query(
    "worst_first_pages",
    """SELECT page_id AS page_key, s.client_id, name AS client_name, CAST(floor(100.0 * (14 - lost) / 14 + 0.5) AS BIGINT) AS score, lost AS points_lost, latest_position, latest_ts
    FROM scored s JOIN clients c USING (client_id) LEFT JOIN latest l ON l.page_no = s.client_id % 200
    ORDER BY (14 - lost) / 14.0, lost DESC, name, s.client_id, place, run_id LIMIT 20""",
)
def worst_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst current pages: slice first by a total order, then enrich the slice."""
    kept = (F.lit(m.POSSIBLE) - F.col("lost")) / F.lit(m.POSSIBLE)
    p = m.scored_pages(spark, sf_dir).join(m.clients(spark, sf_dir), "client_id")
    top = p.orderBy(kept, F.desc("lost"), "name", "client_id", "place", "run_id").limit(20).withColumn("page_no", F.col("client_id") % 200)
    return top.join(m.latest_positions(spark, sf_dir), "page_no", "left").select(
        F.col("page_id").alias("page_key"), "client_id", F.col("name").alias("client_name"), F.floor(100 * kept + 0.5).alias("score"), F.col("lost").alias("points_lost"), "latest_position", "latest_ts"
    )


# filters and projections


@query("scan_table", "SELECT * FROM nation")
def scan_table(spark, sf_dir):
    return m.table(spark, sf_dir, "nation")


@query("scan_array_param", "SELECT page_id, place FROM (VALUES (11::BIGINT, 1), (23, 2), (47, 3)) v(page_id, place)")
def scan_array_param(spark, sf_dir):
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (11, 23, 47)]))).select(F.col("col").alias("page_id"), (F.col("pos") + 1).alias("place"))


@query(
    "proj_columns",
    "SELECT a.c_custkey AS client_id, a.s_acctbal AS ps_value, b.s_acctbal AS psd_value FROM (SELECT c_custkey, s_acctbal FROM customer JOIN supplier ON s_suppkey = c_custkey % 10 + 1) a JOIN (SELECT c_custkey, s_acctbal FROM customer JOIN supplier ON s_suppkey = c_custkey % 7 + 1) b USING (c_custkey)",
)
def proj_columns(spark, sf_dir):
    """One projection under two prefixes, for two joins of one table."""
    s, c = m.table(spark, sf_dir, "supplier"), m.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"))

    def speed(prefix: str, n: int):
        return s.select((F.col("s_suppkey") - 1).alias(f"{prefix}_key"), F.col("s_acctbal").alias(f"{prefix}_value")).where(f"{prefix}_key < {n}")

    out = c.join(speed("ps", 10), F.col("client_id") % 10 == F.col("ps_key")).join(speed("psd", 7), F.col("client_id") % 7 == F.col("psd_key"))
    return out.select("client_id", "ps_value", "psd_value")


@query("filter_eq_scope", "SELECT r.run_id, r.status FROM runs r JOIN clients c USING (client_id) WHERE c.user_id = 7")
def filter_eq_scope(spark, sf_dir):
    return m.runs(spark, sf_dir).join(m.clients(spark, sf_dir).where("user_id = 7"), "client_id").select("run_id", "status")


@query("filter_in", "SELECT run_id, client_id FROM runs WHERE status IN ('succeeded', 'partial') AND client_id IN (1, 2, 4, 5, 7, 100)")
def filter_in(spark, sf_dir):
    return m.runs(spark, sf_dir).where(F.col("status").isin(*m.CURRENT) & F.col("client_id").isin(1, 2, 4, 5, 7, 100)).select("run_id", "client_id")


_CODES = "(SELECT run_id, list_distinct(list(severity)) AS judged FROM crawled GROUP BY run_id)"


def _judged(spark, sf_dir):
    return m.pages(spark, sf_dir).groupBy("run_id").agg(F.collect_set("severity").alias("judged"))


@query("filter_any_array", f"SELECT run_id FROM {_CODES} WHERE list_contains(judged, 'error')")
def filter_any_array(spark, sf_dir):
    return _judged(spark, sf_dir).where(F.array_contains("judged", "error")).select("run_id")


@query("filter_array_overlap", f"SELECT run_id FROM {_CODES} WHERE list_has_any(judged, ['warning', 'error'])")
def filter_array_overlap(spark, sf_dir):
    return _judged(spark, sf_dir).where(F.arrays_overlap("judged", F.array(F.lit("warning"), F.lit("error")))).select("run_id")


@query(
    "filter_ilike_search",
    "SELECT client_id, name FROM clients c WHERE name ILIKE '%#00000001%' ESCAPE '\\' OR EXISTS (SELECT 1 FROM runs r WHERE r.client_id = c.client_id AND r.priority ILIKE '%1-urg%' ESCAPE '\\')",
)
def filter_ilike_search(spark, sf_dir):
    """Name or a related term; the semi join is one distinct key set, folded with the name test."""
    c = m.clients(spark, sf_dir)
    hit = m.runs(spark, sf_dir).where(F.col("priority").ilike(f"%{escape_like('1-urg')}%")).select("client_id").distinct().withColumn("hit", F.lit(True))
    return c.join(hit, "client_id", "left").where(F.col("name").ilike(f"%{escape_like('#00000001')}%") | F.col("hit")).select("client_id", "name")


@query("filter_date_range", "SELECT snapshot_id FROM snaps WHERE captured_at >= TIMESTAMP '2024-01-05' AND captured_at < TIMESTAMP '2024-01-12'")
def filter_date_range(spark, sf_dir):
    at = F.col("captured_at")
    return m.snapshots(spark, sf_dir).where((at >= F.lit("2024-01-05").cast("timestamp")) & (at < F.lit("2024-01-12").cast("timestamp"))).select("snapshot_id")


#: A run's row as a queue job: attempts from the client, a lease a day after it.
_JOBS = "(SELECT run_id, client_id, status, client_id % 4 AS attempts, finished_at AS next_at, finished_at + INTERVAL 1 DAY AS locked_until FROM runs)"


def jobs(spark, sf_dir):
    return m.runs(spark, sf_dir).select("run_id", "client_id", "status", (F.col("client_id") % 4).alias("attempts"), F.col("finished_at").alias("next_at"), (F.col("finished_at") + F.expr("INTERVAL 1 DAY")).alias("locked_until"))


def due(now: str, most: int = 3):
    """Waiting jobs whose time has come and running ones whose lease is over, with attempts left."""
    at = F.lit(now).cast("timestamp")
    return ((F.col("status") == "partial") & (F.col("next_at") <= at) | (F.col("status") == "running") & (F.col("locked_until") < at)) & (F.col("attempts") < most)


_DUE = f"((status = 'partial' AND next_at <= TIMESTAMP '{NOW}') OR (status = 'running' AND locked_until < TIMESTAMP '{NOW}')) AND attempts < 3"


@query("filter_queue_due", f"SELECT run_id FROM {_JOBS} WHERE {_DUE}")
def filter_queue_due(spark, sf_dir):
    return jobs(spark, sf_dir).where(due(NOW)).select("run_id")


@query("filter_report", "SELECT page_id, severity FROM current_pages JOIN clients USING (client_id) WHERE failed AND severity IN ('error', 'warning') AND (place = 7 OR contains(lower(name), '9'))")
def filter_report(spark, sf_dir):
    """Levels and a text search; rows of the whole site (the last place) survive page filters."""
    p = m.current_pages(spark, sf_dir).join(m.clients(spark, sf_dir), "client_id").where(F.col("failed") & F.col("severity").isin("error", "warning"))
    return p.where((F.col("place") == 7) | F.contains(F.lower("name"), F.lit("9"))).select("page_id", "severity")


@query("filter_guide", "SELECT p_partkey AS entry_id FROM part WHERE lower(p_brand) = 'brand#11' OR (contains(lower(p_name), 'a') AND contains(lower(p_name), 'e'))")
def filter_guide(spark, sf_dir):
    """All words are in the entry, or the entry's code is the query."""
    words = F.array(F.lit("a"), F.lit("e"))
    return m.table(spark, sf_dir, "part").where((F.lower("p_brand") == "brand#11") | F.forall(words, lambda w: F.contains(F.lower("p_name"), w))).select(F.col("p_partkey").alias("entry_id"))


@query("case_expr", "SELECT page_id, CASE WHEN code % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS strategy FROM crawled")
def case_expr(spark, sf_dir):
    return m.pages(spark, sf_dir).select("page_id", F.when(F.col("code") % 2 == 0, "mobile").otherwise("desktop").alias("strategy"))


@query("coalesce_nulls", "SELECT client_id, coalesce(l.latest_position, 0) AS position, (l.latest_position IS NULL) = (l.latest_ts IS NULL) AS paired FROM clients c LEFT JOIN latest l ON l.page_no = c.client_id % 200")
def coalesce_nulls(spark, sf_dir):
    c = m.clients(spark, sf_dir).withColumn("page_no", F.col("client_id") % 200).join(m.latest_positions(spark, sf_dir), "page_no", "left")
    return c.select("client_id", F.coalesce("latest_position", F.lit(0)).alias("position"), (F.col("latest_position").isNull() == F.col("latest_ts").isNull()).alias("paired"))


#: Table constraints as conditions that hold for each row.
CONSTRAINTS = {
    "position_range": ("snaps", "position BETWEEN 1 AND 100"),
    "keyword_named": ("snaps", "keyword <> '' AND keyword = lower(keyword)"),
    "place_range": ("crawled", "place BETWEEN 1 AND 50"),
    "severity_known": ("crawled", "severity IN ('error', 'warning', 'notice')"),
    "words_positive": ("crawled", "words > 10"),
    "status_known": ("runs", "status IN ('queued', 'running', 'succeeded', 'partial', 'failed')"),
    "finished_when_done": ("runs", "status = 'running' OR finished_at IS NOT NULL"),
    "cost_positive": ("runs", "cost > 1000"),
}


@query("check_constraints", " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE NOT ({c})) AS broken FROM {t}" for k, (t, c) in CONSTRAINTS.items()))
def check_constraints(spark, sf_dir):
    """How many rows break each constraint: one aggregate over each table."""
    frames = {"snaps": m.snapshots, "crawled": m.pages, "runs": m.runs}
    out = None
    for name, build in frames.items():
        own = {k: c for k, (t, c) in CONSTRAINTS.items() if t == name}
        counted = build(spark, sf_dir).agg(*[F.count_if(~F.expr(c)).alias(k) for k, c in own.items()])
        rows = counted.unpivot([], list(own), "name", "broken")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("assert_row_scan", "SELECT l_orderkey AS run_id, l_linenumber AS place, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def assert_row_scan(spark, sf_dir):
    return m.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("place")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# joins


@query("join_inner_chain", "SELECT p.page_id, c.name, k.p_name AS term FROM current_pages p JOIN clients c USING (client_id) JOIN part k ON k.p_partkey = p.code")
def join_inner_chain(spark, sf_dir):
    k = m.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("term"))
    return m.current_pages(spark, sf_dir).join(m.clients(spark, sf_dir), "client_id").join(k, "code").select("page_id", "name", "term")


@query("join_inner_compound", "SELECT p.page_id FROM crawled p JOIN current_runs r ON p.run_id = r.run_id AND p.place = r.client_id % 7 + 1")
def join_inner_compound(spark, sf_dir):
    r = m.current_runs(spark, sf_dir).select("run_id", (F.col("client_id") % 7 + 1).alias("place"))
    return m.pages(spark, sf_dir).join(r, ["run_id", "place"]).select("page_id")


@query("join_left_compound", "SELECT c.client_id, r.run_id FROM clients c LEFT JOIN runs r ON r.client_id = c.client_id AND r.status = 'running' AND r.priority = '1-URGENT'")
def join_left_compound(spark, sf_dir):
    r = m.runs(spark, sf_dir).where((F.col("status") == "running") & (F.col("priority") == "1-URGENT")).select("client_id", "run_id")
    return m.clients(spark, sf_dir).select("client_id").join(r, "client_id", "left")


@query(
    "join_left_range",
    "SELECT q.page_no, q.keyword, s.captured_at, s.position FROM (SELECT DISTINCT page_no, keyword FROM snaps) q LEFT JOIN snaps s ON s.page_no = q.page_no AND s.keyword = q.keyword AND s.captured_at >= TIMESTAMP '2024-01-10' AND s.captured_at < TIMESTAMP '2024-01-12'",
)
def join_left_range(spark, sf_dir):
    """Every pair, with its points of a half-open range; a pair without points comes once."""
    s = m.snapshots(spark, sf_dir)
    at = F.col("captured_at")
    inside = s.where((at >= F.lit("2024-01-10").cast("timestamp")) & (at < F.lit("2024-01-12").cast("timestamp"))).select("page_no", "keyword", "captured_at", "position")
    return s.select("page_no", "keyword").distinct().join(inside, ["page_no", "keyword"], "left")


_SPEED = "(SELECT s_suppkey AS page_no, strategy, s_acctbal + CASE strategy WHEN 'mobile' THEN 0 ELSE 1000 END AS lcp FROM supplier CROSS JOIN (VALUES ('mobile'), ('desktop')) v(strategy))"


def speed(spark, sf_dir):
    s = m.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_no"), "s_acctbal")
    both = s.select("page_no", "s_acctbal", F.explode(F.array(*map(F.lit, m.STRATEGIES))).alias("strategy"))
    return both.select("page_no", "strategy", (F.col("s_acctbal") + F.when(F.col("strategy") == "mobile", 0).otherwise(1000)).alias("lcp"))


@query("join_cross_unnest", f"SELECT page_no, strategy, lcp FROM {_SPEED}")
def join_cross_unnest(spark, sf_dir):
    return speed(spark, sf_dir)


@query("join_left_computed_key", f"SELECT p.page_id, p.strategy, s.lcp FROM (SELECT page_id, code % 50 + 1 AS page_no, CASE WHEN code % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS strategy FROM current_pages) p LEFT JOIN {_SPEED} s ON s.page_no = p.page_no AND s.strategy = p.strategy")
def join_left_computed_key(spark, sf_dir):
    p = m.current_pages(spark, sf_dir).select("page_id", (F.col("code") % 50 + 1).alias("page_no"), F.when(F.col("code") % 2 == 0, "mobile").otherwise("desktop").alias("strategy"))
    return p.join(speed(spark, sf_dir), ["page_no", "strategy"], "left").select("page_id", "strategy", "lcp")


@query("join_self_two_aliases", f"SELECT a.page_no, a.lcp AS mobile_lcp, b.lcp AS desktop_lcp FROM {_SPEED} a JOIN {_SPEED} b ON a.page_no = b.page_no AND a.strategy = 'mobile' AND b.strategy = 'desktop'")
def join_self_two_aliases(spark, sf_dir):
    s = speed(spark, sf_dir)
    a = s.where("strategy = 'mobile'").select("page_no", F.col("lcp").alias("mobile_lcp"))
    return a.join(s.where("strategy = 'desktop'").select("page_no", F.col("lcp").alias("desktop_lcp")), "page_no")


@query("join_lateral_latest", "SELECT page_no, keyword, arg_max(position, (captured_at, snapshot_id)) AS position, max(captured_at) AS captured_at FROM snaps GROUP BY ALL")
def join_lateral_latest(spark, sf_dir):
    s = m.snapshots(spark, sf_dir)
    return s.groupBy("page_no", "keyword").agg(F.max_by("position", F.struct("captured_at", "snapshot_id")).alias("position"), F.max("captured_at").alias("captured_at"))


_LOST = "CAST(coalesce(sum(lost), 0) AS BIGINT)"


@query("join_lateral_agg", f"SELECT c.client_id, {_LOST} AS lost FROM clients c LEFT JOIN scored s USING (client_id) GROUP BY c.client_id")
def join_lateral_agg(spark, sf_dir):
    lost = m.scored_pages(spark, sf_dir).groupBy("client_id").agg(F.sum("lost").alias("lost"))
    return m.clients(spark, sf_dir).select("client_id").join(lost, "client_id", "left").fillna(0, ["lost"])


@query("join_lateral_agg_nullable", "SELECT c.client_id, CASE WHEN count(s.page_id) = 0 THEN NULL ELSE CAST(sum(s.lost) AS BIGINT) END AS lost FROM clients c LEFT JOIN scored s USING (client_id) GROUP BY c.client_id")
def join_lateral_agg_nullable(spark, sf_dir):
    """A client that was never judged keeps its null: it is not a zero."""
    lost = m.scored_pages(spark, sf_dir).groupBy("client_id").agg(F.sum("lost").alias("lost"))
    return m.clients(spark, sf_dir).select("client_id").join(lost, "client_id", "left")


@query("join_semi_exists", "SELECT client_id FROM clients c WHERE EXISTS (SELECT 1 FROM runs r WHERE r.client_id = c.client_id AND r.status = 'partial')")
def join_semi_exists(spark, sf_dir):
    return m.clients(spark, sf_dir).select("client_id").join(m.runs(spark, sf_dir).where("status = 'partial'"), "client_id", "left_semi")


@query("join_semi_in_subquery", f"SELECT client_id, user_id FROM clients WHERE user_id IN (SELECT c.user_id FROM {_JOBS} j JOIN clients c USING (client_id) WHERE {_DUE})")
def join_semi_in_subquery(spark, sf_dir):
    """Clients of users with a due job, whatever its run."""
    c = m.clients(spark, sf_dir)
    users = jobs(spark, sf_dir).where(due(NOW)).join(c, "client_id").select("user_id")
    return c.select("client_id", "user_id").join(users, "user_id", "left_semi").select("client_id", "user_id")


@query("join_scalar_latest_run", "SELECT p.page_id FROM crawled p JOIN runs r USING (run_id) WHERE p.run_id = (SELECT x.run_id FROM current_runs x WHERE x.client_id = r.client_id)")
def join_scalar_latest_run(spark, sf_dir):
    return m.current_pages(spark, sf_dir).select("page_id")


@query("join_scalar_count", "SELECT page_id, (SELECT count(*) FROM current_pages b WHERE b.run_id = a.run_id) AS run_pages, (SELECT count(DISTINCT b.severity) FROM current_pages b WHERE b.run_id = a.run_id) AS kinds FROM current_pages a")
def join_scalar_count(spark, sf_dir):
    p = m.current_pages(spark, sf_dir)
    counts = p.groupBy("run_id").agg(F.count(F.lit(1)).alias("run_pages"), F.countDistinct("severity").alias("kinds"))
    return p.select("page_id", "run_id").join(counts, "run_id").select("page_id", "run_pages", "kinds")


@query("join_update_from", f"SELECT j.run_id, CASE WHEN c.run_id IS NOT NULL THEN 'running' ELSE j.status END AS status, CASE WHEN c.run_id IS NOT NULL THEN attempts + 1 ELSE attempts END AS attempts FROM {_JOBS} j LEFT JOIN (SELECT client_id, max(run_id) AS run_id FROM {_JOBS} WHERE {_DUE} GROUP BY client_id) c ON c.run_id = j.run_id")
def join_update_from(spark, sf_dir):
    """Rows that a claim names (the latest due job of each client) take their new values, the others keep theirs."""
    j = jobs(spark, sf_dir)
    claimed = j.where(due(NOW)).groupBy("client_id").agg(F.max("run_id").alias("run_id")).select("run_id", F.lit(True).alias("mine"))
    met = j.join(claimed, "run_id", "left")
    hit = F.coalesce("mine", F.lit(False))
    return met.select("run_id", F.when(hit, "running").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"))


@query("join_previous_crawl", "SELECT a.run_id, max(b.finished_at) AS previous_at FROM runs a LEFT JOIN runs b ON a.client_id = b.client_id AND b.finished_at < a.finished_at GROUP BY a.run_id")
def join_previous_crawl(spark, sf_dir):
    """The crawl before each: a window over the client's runs, not a join of the table with itself."""
    r = m.runs(spark, sf_dir).withColumn("__s", F.unix_micros(F.col("finished_at").cast("timestamp")))
    before = W.partitionBy("client_id").orderBy("__s").rangeBetween(W.unboundedPreceding, -1)
    return r.select("run_id", F.max("finished_at").over(before).alias("previous_at"))


@query("join_map_lookup", "SELECT page_id, CASE severity WHEN 'error' THEN 10 WHEN 'warning' THEN 3 WHEN 'notice' THEN 1 END AS weight FROM crawled")
def join_map_lookup(spark, sf_dir):
    weights = F.create_map(*[x for k, v in m.WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return m.pages(spark, sf_dir).select("page_id", weights[F.col("severity")].alias("weight"))


_UPDATES = "(VALUES ('core', DATE '2024-01-03', DATE '2024-01-09'), ('spam', DATE '2023-12-20', DATE '2024-01-01'), ('other', DATE '2024-02-10', DATE '2024-02-12'), ('late', DATE '2024-01-28', DATE '2024-03-01')) u(kind, day_from, day_to)"


@query("join_interval_overlap", f"SELECT kind, min(day) AS shown_from, max(day) AS shown_to, count(*) AS days FROM {_UPDATES} JOIN (SELECT DISTINCT CAST(captured_at AS DATE) AS day FROM snaps) d ON day BETWEEN day_from AND day_to GROUP BY kind")
def join_interval_overlap(spark, sf_dir):
    """Each update clipped to the days that are shown; updates outside them go. The days are few, so
    the range join is a broadcast of the fixed list of updates."""
    rows = [("core", "2024-01-03", "2024-01-09"), ("spam", "2023-12-20", "2024-01-01"), ("other", "2024-02-10", "2024-02-12"), ("late", "2024-01-28", "2024-03-01")]
    updates = spark.createDataFrame(rows, "kind string, a string, b string").select("kind", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    days = m.snapshots(spark, sf_dir).select(F.to_date("captured_at").alias("day")).distinct()
    met = days.join(F.broadcast(updates), (F.col("day") >= F.col("a")) & (F.col("day") <= F.col("b")))
    return met.groupBy("kind").agg(F.min("day").alias("shown_from"), F.max("day").alias("shown_to"), F.count(F.lit(1)).alias("days"))


@query("join_anti", "SELECT client_id FROM clients c WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.client_id = c.client_id AND r.status = 'partial')")
def join_anti(spark, sf_dir):
    return m.clients(spark, sf_dir).select("client_id").join(m.runs(spark, sf_dir).where("status = 'partial'"), "client_id", "left_anti")


# aggregates


@query("agg_count_star", "SELECT count(*) AS total FROM current_pages")
def agg_count_star(spark, sf_dir):
    return m.current_pages(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))


@query(
    "agg_group_count",
    "SELECT run_id, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'notice') AS notice, count(*) AS total FROM current_pages WHERE failed GROUP BY run_id",
)
def agg_group_count(spark, sf_dir):
    """Findings by severity; an absent severity is 0 and not null."""
    p = m.current_pages(spark, sf_dir).where("failed")
    return p.groupBy("run_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in m.SEVERITIES], F.count(F.lit(1)).alias("total"))


@query("agg_count_distinct", "SELECT client_id, severity, count(DISTINCT page_id) AS pages FROM current_pages WHERE failed GROUP BY ALL")
def agg_count_distinct(spark, sf_dir):
    return m.current_pages(spark, sf_dir).where("failed").groupBy("client_id", "severity").agg(F.countDistinct("page_id").alias("pages"))


@query("agg_two_level", "SELECT p.page_id, count(*) AS shared FROM (SELECT * FROM current_pages WHERE failed) p JOIN (SELECT client_id, severity FROM current_pages WHERE failed GROUP BY ALL HAVING count(DISTINCT page_id) > 1) s USING (client_id, severity) GROUP BY p.page_id")
def agg_two_level(spark, sf_dir):
    p = m.current_pages(spark, sf_dir).where("failed")
    spread = p.groupBy("client_id", "severity").agg(F.countDistinct("page_id").alias("n")).where("n > 1").drop("n")
    return p.join(spread, ["client_id", "severity"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("shared"))


@query("agg_sum_weighted_array", f"SELECT run_id, CAST(sum(CASE c WHEN 'error' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END) AS BIGINT) AS possible FROM (SELECT run_id, unnest(judged) AS c FROM {_CODES}) GROUP BY run_id")
def agg_sum_weighted_array(spark, sf_dir):
    """The weights of an array's codes, summed in the row; a code without a weight counts 1."""
    weights = F.create_map(*[x for k, v in m.WEIGHTS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    total = F.aggregate("judged", F.lit(0).cast("long"), lambda a, c: a + F.coalesce(weights[c], F.lit(1).cast("long")))
    return _judged(spark, sf_dir).select("run_id", total.alias("possible"))


@query("agg_sum_weighted_lost", f"SELECT p.run_id, CAST(sum(CASE p.severity WHEN 'error' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END) AS BIGINT) AS lost FROM crawled p JOIN {_CODES} j USING (run_id) WHERE p.failed AND list_contains(j.judged, p.severity) GROUP BY p.run_id")
def agg_sum_weighted_lost(spark, sf_dir):
    p = m.pages(spark, sf_dir).where("failed").join(_judged(spark, sf_dir), "run_id").where(F.expr("array_contains(judged, severity)"))
    return p.groupBy("run_id").agg(F.sum(m.weight(F.col("severity"))).alias("lost"))


@query("agg_lighthouse_points", "SELECT run_id, CAST(sum(w) AS BIGINT) AS points, count(*) AS codes FROM crawled JOIN (VALUES ('error', 10), ('warning', 3)) a(severity, w) USING (severity) GROUP BY run_id")
def agg_lighthouse_points(spark, sf_dir):
    """Only codes with an active weight count."""
    active = spark.createDataFrame([("error", 10), ("warning", 3)], "severity string, w int")
    return m.pages(spark, sf_dir).join(F.broadcast(active), "severity").groupBy("run_id").agg(F.sum("w").alias("points"), F.count(F.lit(1)).alias("codes"))


@query("agg_max_group", "SELECT user_id, max(served) AS served_at FROM (SELECT c.user_id, c.client_id, max(r.finished_at) AS served FROM clients c JOIN runs r USING (client_id) GROUP BY ALL) GROUP BY user_id")
def agg_max_group(spark, sf_dir):
    by_client = m.runs(spark, sf_dir).groupBy("client_id").agg(F.max("finished_at").alias("served"))
    return m.clients(spark, sf_dir).join(by_client, "client_id").groupBy("user_id").agg(F.max("served").alias("served_at"))


@query("agg_array_distinct_count", "SELECT run_id, len(list_distinct(a)) = len(a) AS clean FROM (SELECT run_id, list(severity) AS a FROM crawled GROUP BY run_id)")
def agg_array_distinct_count(spark, sf_dir):
    """Whether no value repeats: counts, not a list of a run's rows."""
    a = m.pages(spark, sf_dir).groupBy("run_id").agg(F.countDistinct("severity").alias("kinds"), F.count("severity").alias("n"))
    return a.select("run_id", (F.col("kinds") == F.col("n")).alias("clean"))


_LATEST_PAIRS = "(SELECT page_no, keyword, arg_max(position, (captured_at, snapshot_id)) AS position, max(captured_at) AS captured_at FROM snaps GROUP BY ALL)"


@query("agg_best_position", f"SELECT page_no, arg_min(keyword, (position, keyword)) AS keyword, min(position) AS position FROM {_LATEST_PAIRS} GROUP BY page_no")
def agg_best_position(spark, sf_dir):
    pairs = join_lateral_latest(spark, sf_dir)
    return pairs.groupBy("page_no").agg(F.min_by("keyword", F.struct("position", "keyword")).alias("keyword"), F.min("position").alias("position"))


@query("agg_last_captured", "SELECT page_no, max(captured_at) AS captured_at FROM snaps GROUP BY page_no")
def agg_last_captured(spark, sf_dir):
    return m.snapshots(spark, sf_dir).groupBy("page_no").agg(F.max("captured_at").alias("captured_at"))


@query(
    "agg_history_summary",
    """SELECT page_no, keyword, arg_max(position, (captured_at, snapshot_id)) AS latest, CASE WHEN count(*) > 1 THEN arg_min(position, (captured_at, snapshot_id)) - arg_max(position, (captured_at, snapshot_id)) END AS change,
    min(position) AS best, max(position) AS worst, count(*) AS points FROM snaps GROUP BY ALL""",
)
def agg_history_summary(spark, sf_dir):
    at = F.struct("captured_at", "snapshot_id")
    latest, first = F.max_by("position", at), F.min_by("position", at)
    n = F.count(F.lit(1))
    return m.snapshots(spark, sf_dir).groupBy("page_no", "keyword").agg(latest.alias("latest"), F.when(n > 1, first - latest).alias("change"), F.min("position").alias("best"), F.max("position").alias("worst"), n.alias("points"))


_KEYWORDS = ("click", "error", "purchase", "signup", "view")


@query("agg_pivot_day", "SELECT day, " + ", ".join(f"arg_max(position, (captured_at, snapshot_id)) FILTER (WHERE keyword = '{k}') AS {k}" for k in _KEYWORDS) + " FROM (SELECT *, CAST(captured_at AS DATE) AS day FROM snaps WHERE page_no = 3) GROUP BY day")
def agg_pivot_day(spark, sf_dir):
    """A day by keyword table of one page; the last point of a day wins."""
    s = m.snapshots(spark, sf_dir).where("page_no = 3").withColumn("day", F.to_date("captured_at"))
    return s.groupBy("day").pivot("keyword", list(_KEYWORDS)).agg(F.max_by("position", F.struct("captured_at", "snapshot_id")))


@query("agg_series_nest")
def agg_series_nest(spark, sf_dir):
    """A page's series: one array of points for each keyword of a page, in time order (a year of days
    at most, so the array is small)."""
    s = m.snapshots(spark, sf_dir)
    points = F.array_sort(F.collect_list(F.struct("captured_at", "position")))
    return s.groupBy("page_no", "keyword").agg(points.alias("points"))


@query("agg_page_score", "SELECT client_id, CAST(floor(100.0 * (14 * count(*) - sum(lost)) / (14 * count(*)) + 0.5) AS BIGINT) AS score FROM scored GROUP BY client_id")
def agg_page_score(spark, sf_dir):
    s = m.scored_pages(spark, sf_dir).groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.sum("lost").alias("lost"))
    return s.select("client_id", F.floor(F.lit(100.0) * (14 * F.col("n") - F.col("lost")) / (14 * F.col("n")) + 0.5).alias("score"))


@query("agg_group_by_issue", "SELECT severity, count(DISTINCT page_id) AS pages, count(DISTINCT client_id) AS clients, CAST(sum(CASE WHEN place = 7 THEN 1 ELSE 0 END) AS BIGINT) AS whole_site FROM current_pages WHERE failed GROUP BY severity")
def agg_group_by_issue(spark, sf_dir):
    p = m.current_pages(spark, sf_dir).where("failed")
    return p.groupBy("severity").agg(F.countDistinct("page_id").alias("pages"), F.countDistinct("client_id").alias("clients"), F.sum((F.col("place") == 7).cast("long")).alias("whole_site"))


@query(
    "agg_group_by_page",
    "SELECT client_id, page_id, CAST(sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error, CAST(sum(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning, CAST(sum(CASE WHEN severity = 'notice' THEN 1 ELSE 0 END) AS BIGINT) AS notice FROM current_pages WHERE failed GROUP BY ALL",
)
def agg_group_by_page(spark, sf_dir):
    p = m.current_pages(spark, sf_dir).where("failed").groupBy("client_id", "page_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in m.SEVERITIES])
    return p.orderBy(F.desc("error"), F.desc("warning"), F.desc("notice"), "page_id")


@query("agg_collapse_origin", "SELECT * EXCLUDE (n) FROM (SELECT keyword, page_no, position, captured_at, count(*) OVER (PARTITION BY keyword) AS grouped, row_number() OVER (PARTITION BY keyword ORDER BY captured_at DESC, page_no DESC) AS n FROM snaps WHERE position > 50) WHERE n = 1")
def agg_collapse_origin(spark, sf_dir):
    """Findings that share an origin become one: the latest measured, with the size of its group."""
    s = m.snapshots(spark, sf_dir).where("position > 50")
    best = F.max_by(F.struct("page_no", "position", "captured_at"), F.struct("captured_at", "page_no"))
    return s.groupBy("keyword").agg(best.alias("x"), F.count(F.lit(1)).alias("grouped")).select("keyword", "x.page_no", "x.position", "x.captured_at", "grouped")


@query("agg_counts_per_value", "SELECT client_id, arg_min(priority, (-n, first_run)) AS mode, max(n) AS times FROM (SELECT client_id, priority, count(*) AS n, min(run_id) AS first_run FROM runs GROUP BY ALL) GROUP BY client_id")
def agg_counts_per_value(spark, sf_dir):
    """The most frequent value, of equal ones the first seen."""
    n = m.runs(spark, sf_dir).groupBy("client_id", "priority").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))
    return n.groupBy("client_id").agg(F.min_by("priority", F.struct(-F.col("n"), F.col("first_run"))).alias("mode"), F.max("n").alias("times"))


@query("agg_sum_clients", "SELECT user_id, count(DISTINCT p.page_id) AS pages FROM clients c JOIN current_pages p USING (client_id) GROUP BY user_id")
def agg_sum_clients(spark, sf_dir):
    p = m.current_pages(spark, sf_dir).groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    return m.clients(spark, sf_dir).join(p, "client_id").groupBy("user_id").agg(F.sum("n").alias("pages"))


@query(
    "agg_precision",
    "SELECT lang, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS junk, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, round(count(*) FILTER (WHERE quality = 1) / nullif(count(quality), 0)::DOUBLE, 9) AS precision FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
)
def agg_precision(spark, sf_dir):
    d = m.table(spark, sf_dir, "documents").select("doc_id", "lang").join(m.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    good, known = F.count_if(F.col("quality") == 1), F.count("quality")
    return d.groupBy("lang").agg(good.alias("good"), F.count_if(F.col("quality") == 0).alias("junk"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.round(F.when(known > 0, good / known), 9).alias("precision"))


# windows, order, slices, sets


@query("win_current_run", "SELECT run_id, client_id, status FROM current_runs")
def win_current_run(spark, sf_dir):
    return m.current_runs(spark, sf_dir).select("run_id", "client_id", "status")


@query("win_latest_run_any", "SELECT client_id, arg_max(run_id, (finished_at, run_id)) AS run_id FROM runs GROUP BY client_id")
def win_latest_run_any(spark, sf_dir):
    return m.runs(spark, sf_dir).groupBy("client_id").agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("run_id"))


@query("win_latest_per_pair", f"SELECT page_no, keyword, position FROM {_LATEST_PAIRS}")
def win_latest_per_pair(spark, sf_dir):
    return join_lateral_latest(spark, sf_dir).select("page_no", "keyword", "position")


@query("win_sequence_gap", "SELECT run_id, min(place) AS place FROM (SELECT run_id, place, place - lag(place) OVER (PARTITION BY run_id ORDER BY place) AS step FROM crawled) WHERE step > 1 GROUP BY run_id")
def win_sequence_gap(spark, sf_dir):
    step = F.col("place") - F.lag("place").over(W.partitionBy("run_id").orderBy("place"))
    return m.pages(spark, sf_dir).withColumn("step", step).where("step > 1").groupBy("run_id").agg(F.min("place").alias("place"))


@query("win_first_dup", "SELECT page_no, keyword, min(snapshot_id) AS snapshot_id FROM snaps GROUP BY ALL")
def win_first_dup(spark, sf_dir):
    """The first of each key keeps its place."""
    s = m.snapshots(spark, sf_dir)
    return s.groupBy("page_no", "keyword").agg(F.min("snapshot_id").alias("snapshot_id"))


@query("sort_worst_first", "SELECT page_id, lost FROM scored JOIN clients USING (client_id) ORDER BY (14 - lost) / 14.0, lost DESC, name, client_id, place, page_id LIMIT 20 OFFSET 20")
def sort_worst_first(spark, sf_dir):
    p = m.scored_pages(spark, sf_dir).join(m.clients(spark, sf_dir), "client_id")
    return p.orderBy((14 - F.col("lost")) / 14, F.desc("lost"), "name", "client_id", "place", "page_id").offset(20).limit(20).select("page_id", "lost")


def page_slice_of(page: int = 1, size: int = 20, most: int = 50) -> tuple[int, int]:
    """(offset, limit) of a page of results."""
    size = max(1, min(size, most))
    return (max(1, page) - 1) * size, size


@query("page_slice", "SELECT client_id, name FROM clients ORDER BY name, client_id LIMIT 50 OFFSET 100")
def page_slice(spark, sf_dir):
    offset, limit = page_slice_of(3, 80)
    return m.clients(spark, sf_dir).orderBy("name", "client_id").offset(offset).limit(limit).select("client_id", "name")


@query("sort_nulls_first", "SELECT client_id, latest_ts FROM clients c LEFT JOIN latest l ON l.page_no = c.client_id % 200 ORDER BY latest_ts NULLS FIRST, client_id LIMIT 30")
def sort_nulls_first(spark, sf_dir):
    c = m.clients(spark, sf_dir).withColumn("page_no", F.col("client_id") % 200).join(m.latest_positions(spark, sf_dir), "page_no", "left")
    return c.orderBy(F.asc_nulls_first("latest_ts"), "client_id").limit(30).select("client_id", "latest_ts")


@query("claim_fifo", f"SELECT run_id FROM {_JOBS} WHERE {_DUE} ORDER BY next_at, run_id LIMIT 1")
def claim_fifo(spark, sf_dir):
    """The oldest job that is due; one writer claims, so no lock is needed."""
    return jobs(spark, sf_dir).where(due(NOW)).orderBy("next_at", "run_id").limit(1).select("run_id")


@query(
    "claim_fair",
    f"""SELECT j.run_id, c.user_id, j.client_id, j.run_id % 2 AS device FROM {_JOBS} j JOIN clients c USING (client_id)
    LEFT JOIN (SELECT client_id, max(finished_at) AS cs FROM runs WHERE status = 'succeeded' GROUP BY client_id) a USING (client_id)
    LEFT JOIN (SELECT user_id, max(finished_at) AS us FROM runs JOIN clients USING (client_id) WHERE status = 'succeeded' GROUP BY user_id) b USING (user_id)
    WHERE {_DUE} ORDER BY us NULLS FIRST, cs NULLS FIRST, next_at, j.run_id % 2, j.run_id LIMIT 10""",
)
def claim_fair(spark, sf_dir):
    """Due jobs of the least recently served user, then client, then by age, then by device, the first one first."""
    c = m.clients(spark, sf_dir).select("client_id", "user_id")
    served = m.runs(spark, sf_dir).where("status = 'succeeded'").groupBy("client_id").agg(F.max("finished_at").alias("cs"))
    users = served.join(c, "client_id").groupBy("user_id").agg(F.max("cs").alias("us"))
    j = jobs(spark, sf_dir).where(due(NOW)).withColumn("device", F.col("run_id") % 2).join(c, "client_id").join(served, "client_id", "left").join(users, "user_id", "left")
    return j.orderBy(F.asc_nulls_first("us"), F.asc_nulls_first("cs"), "next_at", "device", "run_id").limit(10).select("run_id", "user_id", "client_id", "device")


@query("sort_catalogue", "SELECT page_id, severity, place FROM current_pages ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, page_id")
def sort_catalogue(spark, sf_dir):
    """All current pages in the catalogue's order."""
    order = F.array_position(F.array(*map(F.lit, m.SEVERITIES)), F.col("severity"))
    return m.current_pages(spark, sf_dir).orderBy(order, "page_id").select("page_id", "severity", "place")


@query("limit_windowed", "SELECT run_id, page_id FROM (SELECT run_id, page_id, place, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM crawled) WHERE coalesce(before, 0) < 2")
def limit_windowed(spark, sf_dir):
    """Places are taken in order until enough have been accepted."""
    before = F.sum(F.col("failed").cast("int")).over(W.partitionBy("run_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return m.pages(spark, sf_dir).withColumn("before", F.coalesce(before, F.lit(0))).where("before < 2").select("run_id", "page_id")


@query("limit_evidence", "SELECT run_id, list_transform(list_sort(list(code))[1:5], lambda x: CASE WHEN length(x::VARCHAR) > 3 THEN left(x::VARCHAR, 3) || '…' ELSE x::VARCHAR END)::VARCHAR AS evidence FROM crawled GROUP BY run_id")
def limit_evidence(spark, sf_dir):
    """The first five items, each cut with an ellipsis."""
    def cut(x):
        text = x.cast("string")
        return F.when(F.length(text) > 3, F.concat(F.substring(text, 1, 3), F.lit("…"))).otherwise(text)

    # cut before it is gathered: at most five rows a run
    first = m.pages(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("run_id").orderBy("code"))).where("n <= 5")
    items = first.groupBy("run_id").agg(F.array_sort(F.collect_list("code")).alias("items"))
    return items.select("run_id", F.concat(F.lit("["), F.array_join(F.transform("items", cut), ", "), F.lit("]")).alias("evidence"))


@query("set_union_distinct", "SELECT client_id FROM runs WHERE status = 'running' UNION SELECT client_id FROM clients WHERE user_id = 3")
def set_union_distinct(spark, sf_dir):
    return m.runs(spark, sf_dir).where("status = 'running'").select("client_id").union(m.clients(spark, sf_dir).where("user_id = 3").select("client_id")).distinct()


@query("set_intersect", "SELECT client_id FROM runs WHERE status = 'running' INTERSECT SELECT client_id FROM runs WHERE status = 'partial'")
def set_intersect(spark, sf_dir):
    r = m.runs(spark, sf_dir)
    return r.where("status = 'running'").select("client_id").intersect(r.where("status = 'partial'").select("client_id"))


@query("set_except", "SELECT client_id FROM clients EXCEPT SELECT client_id FROM runs WHERE status = 'partial'")
def set_except(spark, sf_dir):
    return m.clients(spark, sf_dir).select("client_id").subtract(m.runs(spark, sf_dir).where("status = 'partial'").select("client_id"))


@query("set_concat", "SELECT page_id, 'page' AS kind FROM current_pages WHERE failed UNION ALL SELECT run_id, 'site' FROM current_runs")
def set_concat(spark, sf_dir):
    p = m.current_pages(spark, sf_dir).where("failed").select("page_id", F.lit("page").alias("kind"))
    return p.unionByName(m.current_runs(spark, sf_dir).select(F.col("run_id").alias("page_id"), F.lit("site").alias("kind")))


# dataflow


@query("run_outcome", "SELECT run_id, CASE WHEN count(*) FILTER (WHERE failed) = 0 THEN 'succeeded' WHEN bool_and(failed) THEN 'failed' WHEN count(*) FILTER (WHERE NOT failed) >= 3 THEN 'succeeded' ELSE 'partial' END AS outcome FROM crawled GROUP BY run_id")
def run_outcome(spark, sf_dir):
    """A run's status from those of its pages."""
    p = m.pages(spark, sf_dir).groupBy("run_id").agg(F.count_if("failed").alias("bad"), F.bool_and("failed").alias("all_bad"), F.count_if(~F.col("failed")).alias("good"))
    return p.select("run_id", F.when(F.col("bad") == 0, "succeeded").when(F.col("all_bad"), "failed").when(F.col("good") >= 3, "succeeded").otherwise("partial").alias("outcome"))


#: Links that a run may check.
MOST_LINKS = 300


@query("outbound_plan", "SELECT run_id, code, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY place, code) AS n FROM (SELECT run_id, code, min(place) AS place FROM crawled WHERE code NOT IN (SELECT client_id FROM clients) GROUP BY run_id, code)) WHERE n <= 300")
def outbound_plan(spark, sf_dir):
    """Distinct outgoing links in sitemap order within a budget, without any own page."""
    own = m.clients(spark, sf_dir).select(F.col("client_id").alias("code"))
    links = m.pages(spark, sf_dir).groupBy("run_id", "code").agg(F.min("place").alias("place")).join(own, "code", "left_anti")
    return links.withColumn("n", F.row_number().over(W.partitionBy("run_id").orderBy("place", "code"))).where(F.col("n") <= MOST_LINKS).select("run_id", "code", "place")


@query("current_pairs", f"SELECT c.client_id, l.keyword, l.position, l.captured_at FROM current_runs c JOIN {_LATEST_PAIRS} l ON l.page_no = c.client_id % 200")
def current_pairs(spark, sf_dir):
    r = m.current_runs(spark, sf_dir).select("client_id", (F.col("client_id") % 200).alias("page_no"))
    return r.join(join_lateral_latest(spark, sf_dir), "page_no").select("client_id", "keyword", "position", "captured_at")


@query(
    "fill_positions",
    f"SELECT page_no, keyword, CAST(d AS DATE) AS day FROM (SELECT page_no, keyword, unnest(generate_series(CAST(captured_at AS DATE) + INTERVAL 1 DAY, TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d FROM {_LATEST_PAIRS} WHERE CAST(captured_at AS DATE) < DATE '2024-01-30')",
)
def fill_positions(spark, sf_dir):
    """The days each pair still lacks, from the day after its last capture."""
    pairs = join_lateral_latest(spark, sf_dir).withColumn("last", F.to_date("captured_at")).where(F.col("last") < F.lit("2024-01-30").cast("date"))
    return pairs.select("page_no", "keyword", F.explode(F.sequence(F.date_add("last", 1), F.lit("2024-01-30").cast("date"))).alias("day"))


@query("compose_page_checks", f"SELECT j.run_id, s.severity AS code, CASE WHEN list_contains(f.failed, s.severity) THEN 'failed' WHEN list_contains(j.judged, s.severity) THEN 'passed' ELSE 'notYetChecked' END AS state FROM {_CODES} j CROSS JOIN (VALUES ('error'), ('warning'), ('notice')) s(severity) LEFT JOIN (SELECT run_id, list_distinct(list(severity)) AS failed FROM crawled WHERE failed GROUP BY run_id) f USING (run_id)")
def compose_page_checks(spark, sf_dir):
    """Every code of the catalogue with its state on each run; failure is asked before membership."""
    failed = m.pages(spark, sf_dir).where("failed").groupBy("run_id").agg(F.collect_set("severity").alias("bad"))
    rows = _judged(spark, sf_dir).join(failed, "run_id", "left").select("run_id", "judged", "bad", F.explode(F.array(*map(F.lit, m.SEVERITIES))).alias("code"))
    state = F.when(F.expr("array_contains(bad, code)"), "failed").when(F.expr("array_contains(judged, code)"), "passed").otherwise("notYetChecked")
    return rows.select("run_id", "code", state.alias("state"))
