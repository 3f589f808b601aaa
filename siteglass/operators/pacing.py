"""Calls in time: spacing and pauses of a rate limit, and a cached answer that outlives failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def paced(calls: DataFrame, key: str, asked: str, order: list[str], gap: float = 1.0) -> DataFrame:
    """calls with `sent`, in seconds: each of a key at least `gap` after the one before it, none before it was
    asked. The sending time of the n-th call is the largest of asked + gap * (calls since), so no loop is needed."""
    own = W.partitionBy(key).orderBy(asked, *order)
    n = F.row_number().over(own) - 1
    ahead = calls.withColumn("__n", n).withColumn("__free", F.col(asked) - F.col("__n") * gap)
    latest = F.max("__free").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    return ahead.withColumn("sent", latest + F.col("__n") * gap).drop("__n", "__free")


def held_until(calls: DataFrame, key: str, at: str, order: list[str], pause: Column, halted: Column) -> DataFrame:
    """calls with `paused_until`, the longest pause (seconds, null for none) that answers before it ask for, and
    `halted`, whether the key was refused before it."""
    before = W.partitionBy(key).orderBy(at, *order).rowsBetween(W.unboundedPreceding, -1)
    until = F.max(F.when(pause.isNotNull(), F.col(at) + pause)).over(before)
    return calls.withColumn("paused_until", until).withColumn("halted", F.coalesce(F.max(halted).over(before), F.lit(False)))


def cached(fetches: DataFrame, key: str, at: str, order: list[str], value: str) -> DataFrame:
    """fetches (value null where one failed) with `answer`, the latest value so far, kept through failures, and
    `available`, whether there is one."""
    so_far = W.partitionBy(key).orderBy(at, *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return fetches.withColumn("answer", F.last(value, ignorenulls=True).over(so_far)).withColumn("available", F.col("answer").isNotNull())
