"""Writes on the driver's tables: each query returns the table after the write."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteglass.operators import writes as w
from siteglass.plans import model as m
from siteglass.plans.registry import query

_OLD = "(SELECT page_no, keyword, arg_max(position, (captured_at, snapshot_id)) AS position FROM snaps WHERE captured_at < TIMESTAMP '2024-01-20' GROUP BY ALL)"
_NEW = "(SELECT page_no, keyword, arg_max(position, (captured_at, snapshot_id)) AS position FROM snaps WHERE captured_at >= TIMESTAMP '2024-01-15' GROUP BY ALL)"


def _state(spark, sf_dir, old: bool):
    s = m.snapshots(spark, sf_dir)
    at = F.col("captured_at")
    s = s.where(at < F.lit("2024-01-20").cast("timestamp")) if old else s.where(at >= F.lit("2024-01-15").cast("timestamp"))
    return s.groupBy("page_no", "keyword").agg(F.max_by("position", F.struct("captured_at", "snapshot_id")).alias("position"))


@query("sink_upsert", f"SELECT coalesce(n.page_no, o.page_no) AS page_no, coalesce(n.keyword, o.keyword) AS keyword, coalesce(n.position, o.position) AS position FROM {_OLD} o FULL JOIN {_NEW} n ON n.page_no = o.page_no AND n.keyword = o.keyword")
def sink_upsert(spark, sf_dir):
    return w.upsert(_state(spark, sf_dir, True), _state(spark, sf_dir, False), ["page_no", "keyword"])


@query("sink_upsert_cond", f"SELECT coalesce(n.page_no, o.page_no) AS page_no, coalesce(n.keyword, o.keyword) AS keyword, CASE WHEN o.position IS NULL OR (o.position > 50 AND n.position IS NOT NULL) THEN n.position ELSE o.position END AS position FROM {_OLD} o FULL JOIN {_NEW} n ON n.page_no = o.page_no AND n.keyword = o.keyword")
def sink_upsert_cond(spark, sf_dir):
    return w.upsert_if(_state(spark, sf_dir, True), _state(spark, sf_dir, False), ["page_no", "keyword"], F.col("o.position") > 50)


@query("sink_insert_ignore", f"SELECT * FROM {_OLD} UNION ALL SELECT n.* FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.page_no = n.page_no AND o.keyword = n.keyword)")
def sink_insert_ignore(spark, sf_dir):
    return w.insert_ignore(_state(spark, sf_dir, True), _state(spark, sf_dir, False), ["page_no", "keyword"])


@query("sink_replace_partial", f"SELECT * FROM {_OLD} o WHERE NOT (keyword IN ('click', 'view') AND page_no IN (SELECT page_no FROM {_NEW} WHERE keyword IN ('click', 'view'))) UNION ALL SELECT * FROM {_NEW} WHERE keyword IN ('click', 'view')")
def sink_replace_partial(spark, sf_dir):
    owned = F.col("keyword").isin("click", "view")
    return w.replace_partial(_state(spark, sf_dir, True), _state(spark, sf_dir, False).where(owned), ["page_no"], owned)


@query("sink_replace_run", f"SELECT * FROM {_OLD} WHERE page_no NOT IN (SELECT page_no FROM {_NEW} WHERE page_no % 3 = 0) UNION ALL SELECT * FROM {_NEW} WHERE page_no % 3 = 0")
def sink_replace_run(spark, sf_dir):
    return w.replace_run(_state(spark, sf_dir, True), _state(spark, sf_dir, False).where("page_no % 3 = 0"), "page_no")


@query("sink_delete_cascade", "SELECT run_id, client_id FROM runs WHERE client_id NOT IN (SELECT client_id FROM clients WHERE user_id = 5)")
def sink_delete_cascade(spark, sf_dir):
    c = m.clients(spark, sf_dir)
    gone = c.where("user_id = 5").select("client_id")
    return w.delete_cascade(c, gone, {"runs": (m.runs(spark, sf_dir), "client_id")})["runs"].select("run_id", "client_id")


@query("sink_finalize")
def sink_finalize(spark, sf_dir):
    """A run's outcome as it would be committed; the test commits it to a folder."""
    return m.current_runs(spark, sf_dir).select("run_id", "client_id", "status")


@query("st_queue_speed", "SELECT run_id, CASE WHEN n <= 5 THEN 'running' ELSE status END AS status, CASE WHEN n <= 5 THEN attempts + 1 ELSE attempts END AS attempts FROM (SELECT *, CASE WHEN is_due THEN row_number() OVER (PARTITION BY is_due ORDER BY next_at, run_id) END AS n FROM (SELECT *, ((status = 'partial' AND next_at <= TIMESTAMP '1998-06-01') OR (status = 'running' AND locked_until < TIMESTAMP '1998-06-01')) AND attempts < 3 AS is_due FROM (SELECT run_id, status, client_id % 4 AS attempts, finished_at AS next_at, finished_at + INTERVAL 1 DAY AS locked_until FROM runs)))")
def st_queue_speed(spark, sf_dir):
    from siteglass.plans.relational import NOW, due, jobs

    now = F.lit(NOW).cast("timestamp")
    return w.claim(jobs(spark, sf_dir), due(NOW), [F.col("next_at"), F.col("run_id")], now, "60 SECONDS", 5).select("run_id", "status", "attempts")


@query("st_late", f"SELECT page_no, keyword, min(position) AS position FROM (SELECT o.* FROM {_OLD} o UNION ALL SELECT n.* FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_OLD} o WHERE o.page_no = n.page_no AND o.keyword = n.keyword)) GROUP BY ALL")
def st_late(spark, sf_dir):
    """A late capture fills only what is missing."""
    return w.insert_ignore(_state(spark, sf_dir, True), _state(spark, sf_dir, False), ["page_no", "keyword"])
