"""Writes as pure functions: the old state and an input give the new state.

A file table has no rows to lock or update, so each function returns the whole new table; the caller
commits it by one atomic rename or partition overwrite. Each needs one join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key; a null in a new row replaces too."""
    o, n = old.withColumn("__old", F.lit(True)), new.withColumn("__new", F.lit(True))
    joined = o.alias("o").join(n.alias("n"), keys, "full_outer")
    rest = [c for c in old.columns if c not in keys]
    return joined.select(*keys, *[F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])


def upsert_if(old: DataFrame, new: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """As upsert, but an old row gives way only where the condition on it (as o.column) holds."""
    joined = old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), keys, "full_outer")
    rest = [c for c in old.columns if c not in keys]
    taken = F.col("__new") & (F.col("__old").isNull() | condition)
    return joined.select(*keys, *[F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new keys only; of several with one key the smallest, column by column, so that a task that runs
    again chooses alike."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*") if rest else new.distinct()
    return old.unionByName(first.select(*new.columns).join(old.select(*keys), keys, "left_anti"))


def replace_partial(old: DataFrame, new: DataFrame, groups: list[str], owned: Column) -> DataFrame:
    """Within the groups that new names, rows that the writer owns are replaced; other writers' stay."""
    named = new.select(*groups).distinct().withColumn("__named", F.lit(True))
    kept = old.join(named, groups, "left").where(~(F.coalesce("__named", F.lit(False)) & owned)).drop("__named")
    return kept.unionByName(new)


def replace_run(old: DataFrame, new: DataFrame, run: str) -> DataFrame:
    """All rows of the runs that new names are replaced; as files, a dynamic partition overwrite."""
    return old.join(new.select(run).distinct(), run, "left_anti").unionByName(new)


def delete_cascade(parents: DataFrame, gone: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Parents without `gone` (same key column), and their children without the rows of gone parents."""
    key = gone.columns[0]
    out = {"parents": parents.join(gone, key, "left_anti")}
    for name, (child, column) in children.items():
        out[name] = child.join(gone.select(F.col(key).alias(column)), column, "left_anti")
    return out


def claim(jobs: DataFrame, due: Column, order: list[Column], now: Column, lease: str, n: int = 1) -> DataFrame:
    """jobs after the first n that are due were claimed: running, one more attempt, under a lease."""
    chosen = jobs.where(due).orderBy(*order).limit(n).select("run_id").withColumn("__mine", F.lit(True))
    joined = jobs.join(F.broadcast(chosen), "run_id", "left")
    mine = F.coalesce("__mine", F.lit(False))
    return joined.select(
        *[c for c in jobs.columns if c not in ("status", "attempts", "locked_until")],
        F.when(mine, "running").otherwise(F.col("status")).alias("status"),
        F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(mine, now + F.expr(f"INTERVAL {lease}")).otherwise(F.col("locked_until")).alias("locked_until"),
    )


def settle(jobs: DataFrame, results: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """jobs after results (run_id, attempt, ok): a result counts only for the attempt that holds the
    lease; a failure waits 60, 240, 960 ... seconds for the next attempt until none is left."""
    joined = jobs.join(results, "run_id", "left")
    fenced = (F.col("status") == "running") & (F.col("attempt") == F.col("attempts"))
    failed = fenced & ~F.col("ok")
    delay = (F.lit(60) * F.pow(F.lit(4.0), F.col("attempts") - 1)).cast("long")
    status = F.when(fenced & F.col("ok"), "done").when(failed & (F.col("attempts") >= most), "failed").when(failed, "queued").otherwise(F.col("status"))
    later = F.when(failed, F.timestamp_seconds(F.unix_seconds(now) + delay)).otherwise(F.col("next_at"))
    return joined.select(*[c for c in jobs.columns if c not in ("status", "next_at")], status.alias("status"), later.alias("next_at"))


def finalize(frames: dict[str, DataFrame], folder: str) -> None:
    """Writes all results of a run beside each other, and the manifest that makes them count last."""
    spark = next(iter(frames.values())).sparkSession
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(n,) for n in sorted(frames)], "name string").coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")


def is_final(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
