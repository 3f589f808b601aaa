"""The engine's relations over the driver's tables, as DataFrames and as a SQL prelude.

A client is a customer (its user the nation), a crawl run an order, a page of a run a line item, a
finding the line's return flag, a rank snapshot an event. `now` is always a parameter, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses of a run that make it current, and of one still at work.
CURRENT, ACTIVE = ("succeeded", "partial"), ("queued", "running")
#: Points a check is worth by severity.
WEIGHTS = {"error": 10, "warning": 3, "notice": 1}
SEVERITIES = tuple(WEIGHTS)
STRATEGIES = ("mobile", "desktop")
#: A page can lose one check of each severity.
POSSIBLE = sum(WEIGHTS.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("client_id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def run_status(flag: Column) -> Column:
    return F.when(flag == "F", "succeeded").when(flag == "O", "partial").otherwise("running")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("client_id"), run_status(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").alias("finished_at"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("cost"),
    )


def severity(flag: Column) -> Column:
    return F.when(flag == "R", "error").when(flag == "A", "warning").otherwise("notice")


def weight(level: Column) -> Column:
    return F.when(level == "error", 10).when(level == "warning", 3).otherwise(1)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each place of a run's sitemap; of repeated places the smallest (part, supplier)."""
    line = table(spark, sf_dir, "lineitem")
    one = line.groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")).alias("x")
    )
    return one.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_id"), F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("place"),
        F.col("x.l_partkey").alias("code"), severity(F.col("x.l_returnflag")).alias("severity"), (F.col("x.l_discount") >= 0.05).alias("failed"),
        F.col("x.l_quantity").alias("words"), F.col("x.l_linestatus").alias("state"), F.col("x.l_shipdate").alias("crawled_at"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    position = F.least(F.lit(100), F.greatest(F.lit(1), F.floor(F.col("value") + 0.5))).cast("int")
    return e.select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("page_no"), F.col("event_type").alias("keyword"), F.col("ts").alias("captured_at"), position.alias("position"), "props")


def current_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's latest succeeded or partial run; ties go to the larger id."""
    last = W.partitionBy("client_id").orderBy(F.desc("finished_at"), F.desc("run_id"))
    return runs(spark, sf_dir).where(F.col("status").isin(*CURRENT)).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def current_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).join(current_runs(spark, sf_dir).select("run_id", "client_id", "finished_at"), "run_id")


def latest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of each page number: one hash aggregate, not a sort for each row."""
    s = snapshots(spark, sf_dir)
    return s.groupBy("page_no").agg(F.max_by(F.struct("position", "captured_at"), F.struct("captured_at", "snapshot_id")).alias("x")).select("page_no", F.col("x.position").alias("latest_position"), F.col("x.captured_at").alias("latest_ts"))


def scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.when(F.col("failed"), weight(F.col("severity"))).otherwise(0)
    return current_pages(spark, sf_dir).withColumn("lost", lost)


#: The same relations for SQL; queries begin with this and go on with their own SELECT.
PRELUDE = """
WITH clients AS (SELECT c_custkey AS client_id, c_nationkey AS user_id, c_name AS name, c_mktsegment AS segment FROM customer),
runs AS (SELECT o_orderkey AS run_id, o_custkey AS client_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'partial' ELSE 'running' END AS status,
  o_orderdate AS finished_at, o_orderpriority AS priority, o_totalprice AS cost FROM orders),
line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem),
crawled AS (SELECT l_orderkey * 10 + l_linenumber AS page_id, l_orderkey AS run_id, l_linenumber AS place, l_partkey AS code,
  CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'notice' END AS severity, l_discount >= 0.05 AS failed, l_quantity AS words, l_linestatus AS state, l_shipdate AS crawled_at FROM line WHERE rn = 1),
snaps AS (SELECT event_id AS snapshot_id, user_id AS page_no, event_type AS keyword, ts AS captured_at, CAST(least(100, greatest(1, floor(value + 0.5))) AS INTEGER) AS position, props FROM events),
current_runs AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY finished_at DESC, run_id DESC) AS n FROM runs WHERE status IN ('succeeded', 'partial')) WHERE n = 1),
current_pages AS (SELECT p.*, r.client_id, r.finished_at FROM crawled p JOIN current_runs r USING (run_id)),
latest AS (SELECT page_no, arg_max(position, (captured_at, snapshot_id)) AS latest_position, max(captured_at) AS latest_ts FROM snaps GROUP BY page_no),
scored AS (SELECT *, CASE WHEN failed THEN CASE severity WHEN 'error' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END ELSE 0 END AS lost FROM current_pages)
"""
