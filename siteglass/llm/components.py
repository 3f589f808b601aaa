"""Connected components of links in DataFrames: alternating star contractions.

Each round points every node of a neighbourhood at its smallest member, first those above the node,
then those below it; the links shrink to stars around each component's smallest node in a number of
rounds that grows with the logarithm of the longest path. A star's centre may have any share of all
links: its rows are dealt over several tasks. The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import discard, hot_keys, salted_join, stored

MOST_ROUNDS = 40


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    met = salted_join(both.where("v > u"), least.drop("n"), ["u"], hot_keys(least, ["u"], 2 * rows), "v")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    # edges point down: u > v
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    met = salted_join(edges, least.drop("n"), ["u"], hot_keys(least, ["u"], rows), "v")
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) the rows (node, component) of all linked nodes; component is the smallest node."""
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        large = _large_star(edges, state[0])
        new = stored(_small_star(large, state[0]), "stars")
        discard(edges)
        edges = new
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
