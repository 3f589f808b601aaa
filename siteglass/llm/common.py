"""Shared plumbing: shipping the package to executors, scratch tables, guarded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import threading
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: a batch of the longest documents still fits a small Python worker.
ARROW_ROWS = 256

#: The separators of words: everything else is part of a word.
WORD_SPACE = "\\x20\\x09-\\x0D"


def ship(spark: SparkSession) -> None:
    """Makes this package importable on every executor and keeps Arrow batches small.

    The zip is served by Spark itself, so executors need no shared folder for it.
    """
    context = spark.sparkContext
    if getattr(context, "_siteglass_shipped", False) is not True:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="siteglass-")
        target = os.path.join(folder, "siteglass_package.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        context.addPyFile(target)
        context._siteglass_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a local one will do if driver and
    executors are one machine; on a cluster it would lose rows, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="siteglass-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/siteglass/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, so a lost
    executor costs a read and not a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    trim_native(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of tables that `stored` made and nothing reads any more."""
    for table in tables:
        if table is not None and getattr(table, "_scratch", None):
            _delete(table.sparkSession, table._scratch)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end every table stored within it, but for those passed to the function it gives."""
    _SCOPES.append([])
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._scratch)
        return table

    try:
        yield keep
    finally:
        own = _SCOPES.pop()
        for path in own:
            if path not in kept:
                _delete(spark, path)
        if _SCOPES:
            _SCOPES[-1] += kept
        release(spark)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_SCOPES: list[list[str]] = []


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of queries whose results are stored: it does so when the
    driver's objects for them are collected, which else may take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> None:
    """Gives the driver's free native memory back: hundreds of threads plan, compile and broadcast in its JVM, each
    allocates in an arena of its own, and the C library keeps what they free."""
    jvm = spark.sparkContext._jvm

    def array(kind: str, *values: object) -> object:
        out = spark.sparkContext._gateway.new_array(getattr(jvm.java.lang, kind), len(values))
        for k, v in enumerate(values):
            out[k] = v
        return out

    try:
        named = jvm.java.lang.Class.forName
        # by the interface's method: the server's own class is not open to reflection
        kinds = array("Class", *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", kinds)
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array("Object", command, "systemTrimNativeHeap", array("Object"), array("String")))
    except Py4JError:
        pass  # another JVM or C library: its free memory stays with the process


def forget(spark: SparkSession) -> None:
    """Removes every scratch table of this engine under the shared folder."""
    _delete(spark, f"{scratch_root(spark)}/siteglass")


def joined_small(
    left: DataFrame, small: DataFrame, on: list[str] | str, how: str, rows: int, bound: int = 200_000
) -> DataFrame:
    """Joins with a broadcast only if `rows`, the counted size of `small`, is within `bound`;
    beyond it the join shuffles, and skewed keys are left to the adaptive split."""
    return left.join(F.broadcast(small) if rows <= bound else small, on, how)


#: Rows of one key that a task takes without being split, and keys that may be split: fewer rows than
#: LEAST_HOT never are, and the bound rises with the rows, so that at most MOST_HOT keys lie above it.
LEAST_HOT, MOST_HOT = 4096, 500_000


def hot_keys(counted: DataFrame, on: list[str], rows: int) -> DataFrame | None:
    """From counted (on, n), n rows of each key and `rows` in all: (on, parts) of the keys to be split;
    None if no key can be that large."""
    if rows <= LEAST_HOT:
        return None
    most = max(LEAST_HOT, -(-rows // MOST_HOT))
    return counted.where(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias("__parts"))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, by: Column | str, how: str = "inner") -> DataFrame:
    """Joins left with right, where keys of `hot` are dealt over several tasks: left's rows by the hash
    of `by`, right's rows in a copy for each part. hot has some of the columns `on`; by its making it
    has at most MOST_HOT rows."""
    if hot is None:
        return left.join(right, on, how)
    keys = [c for c in hot.columns if c != "__parts"]
    parts = F.coalesce("__parts", F.lit(1))
    one = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    other = right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return one.join(other, [*on, "__salt"], how).drop("__salt")


def words_of(text: Column) -> Column:
    """The words of a text, natively; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+"), lambda w: w != "")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Seconds after which a worker that has not begun another task gives back what it kept.
IDLE = 8.0


def per_worker(make: Callable[[], object], key: tuple) -> object:
    """One object in each Python worker, made anew for another key: the worker process is reused by
    later tasks. What an earlier stage kept must not add up with what later ones need, so an idle worker
    drops it; a task that still runs holds it by itself."""
    with _LOCK:
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = make()
        _USED[0] = time.monotonic()
        if not _WATCH:
            _WATCH.append(threading.Thread(target=_release_idle, daemon=True))
            _WATCH[0].start()
        return _KEPT[key]


def in_use() -> None:
    """Says that the task still works with what its worker keeps: called for each batch."""
    _USED[0] = time.monotonic()


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work for mapInArrow, whose worker gives its free memory back when the task ends: the process waits
    for other tasks, and an executor's memory holds all of them."""

    def run(batches: Iterator) -> Iterator:
        _allocate_apart()
        try:
            yield from work(batches)
        finally:
            _trim()

    return run


def _allocate_apart() -> None:
    """Large blocks are mapped one by one, so that freeing one returns it at once."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD; a fixed one doesn't grow
    except (OSError, AttributeError):
        pass  # another C library


def _trim() -> None:
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: its free memory stays with the process


def _release_idle() -> None:
    while True:
        time.sleep(1.0)
        with _LOCK:
            if _KEPT and time.monotonic() - _USED[0] > IDLE:
                _KEPT.clear()
                gc.collect()
                _trim()


_KEPT: dict[tuple, object] = {}
_USED, _WATCH, _LOCK = [0.0], [], threading.Lock()
