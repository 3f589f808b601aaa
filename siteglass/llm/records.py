"""Token ids as length-delimited binary records with a separate offset index.

A shard file is a header and then one record for each document:

    header  b"SGTR" | version u8 (1) | width of an id u8 (2 or 4) | 2 zero bytes
    record  length u64 | masked CRC-32 of those 8 bytes u32 | payload | masked CRC-32 of the payload u32
    payload doc_id i64 | flags u8 (1: doc_id is null) | ids, little-endian, `width` bytes each

All numbers are little-endian. A CRC is masked by rotating it right by 15 bits and adding a constant,
so that a checksum of data that holds checksums stays sound. The index file has u64 pairs (record's
position in the shard, its number of ids), so that a shuffled reader seeks straight to any record
without scanning; `read_at` does that.

Shards are ranges of doc_id in ascending order. Ids are kept two bytes wide where the vocabulary
allows it. Shards are written under a temporary name and renamed when complete, so a task that runs
again after a lost executor replaces its file with the same bytes. Files live in the cluster's shared
folder (spark.checkpoint.dir) or at a given URI that pyarrow.fs can open.

Null and empty texts are the end id alone; rows with equal doc_id follow each other in the order of
their texts; null doc_ids come first; an empty table gives no files and no rows; other columns are
not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.bpe import WordEncoder
from siteglass.llm.common import in_use, lean, per_worker, scratch, ship, vocabulary_path

MAGIC, VERSION = b"SGTR", 1
MASK = 0xA282EAD8
#: Bytes of text that go into one shard at most, about: its index stays in one task's memory.
SHARD_BYTES = 256 << 20
_LENGTH, _CRC, _KEY, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB"), struct.Struct("<QQ")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CRC.pack(masked(length)), payload, _CRC.pack(masked(payload))))


def unframe(read) -> bytes | None:
    """The next payload, by a function that reads n bytes; None at the end of the file."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != _CRC.unpack(head[8:])[0]:
        raise ValueError("a record's length is damaged")
    n = _LENGTH.unpack(head[:8])[0]
    body = read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != _CRC.unpack(body[n:])[0]:
        raise ValueError("a record's payload is damaged")
    return body[:n]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _write_shard(batches: Iterator[pa.RecordBatch], uri: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    shard = context.partitionId() if context else 0
    encoder = per_worker(lambda: WordEncoder(path), ("encode", path))
    store, base = _open(uri)
    name = f"{base}/shard-{shard:06d}"
    mine = f"{base}/.tmp-{shard:06d}-{context.taskAttemptId() if context else 0}"
    end, n_docs, n_ids, at, out, entries = encoder.pack([end_id]), 0, 0, 8, None, []
    for batch in batches:
        in_use()
        if out is None:
            store.create_dir(base, recursive=True)
            out = store.open_output_stream(f"{mine}.rec")
            out.write(MAGIC + bytes((VERSION, encoder.width, 0, 0)))
        pieces = []
        for d, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist()), strict=True):
            data = frame(_KEY.pack(d or 0, d is None) + ids + end)
            n = len(ids) // encoder.width + 1
            entries.append(_ENTRY.pack(at, n))
            at, n_docs, n_ids = at + len(data), n_docs + 1, n_ids + n
            pieces.append(data)
        out.write(b"".join(pieces))
    if out is None:
        return
    out.close()
    with store.open_output_stream(f"{mine}.idx") as index:
        index.write(b"".join(entries))
    store.move(f"{mine}.idx", f"{name}.idx")
    store.move(f"{mine}.rec", f"{name}.rec")
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [f"{uri}/shard-{shard:06d}"], "n_documents": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_ids], pa.int64())})


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, name = _open(path)
            with store.open_input_stream(f"{name}.rec", buffer_size=1 << 20) as f:
                head = f.read(8)
                if head[:4] != MAGIC or head[4] != VERSION:
                    raise ValueError("not a shard of this format")
                width, at, rows = head[5], 8, []
                while (payload := unframe(f.read)) is not None:
                    key, null = _KEY.unpack(payload[:9])
                    ids = np.frombuffer(payload, f"<u{width}", offset=9)
                    rows.append((None if null else key, start, len(ids), zlib.crc32(ids.astype("<u4").data), path, at))
                    start, at = start + len(ids), at + len(payload) + 16
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)


def _text_bytes(df: DataFrame, text: str) -> int:
    """The bytes of all texts as the scan's statistics have them, or counted where there are none."""
    known = int(str(df.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 60:
        return known
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def write_records(df: DataFrame, uri: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Writes the shards and their indexes below `uri`; returns a row for each shard: shard, path,
    n_documents, n_tokens."""
    spark = df.sparkSession
    ship(spark)
    path = vocabulary or vocabulary_path()
    count = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_text_bytes(df, text) // SHARD_BYTES))
    ordered = (
        df.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
        .repartitionByRange(count, F.col("doc_id"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )

    return ordered.mapInArrow(lean(lambda batches: _write_shard(batches, uri, path, end_id)), "shard long, path string, n_documents long, n_tokens long")


def read_records(spark: SparkSession, shards: list[tuple[str, int]]) -> DataFrame:
    """The records of shards, given as (path, ids before the shard), one task for each: doc_id,
    start, n_tokens, ids_crc32 of the ids as unsigned 32-bit integers, position in the file."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, path string, position long"
    if not shards:
        return spark.createDataFrame([], schema)

    listed = spark.createDataFrame([(k, p, s) for k, (p, s) in enumerate(shards)], "k long, path string, start long")
    return listed.repartitionByRange(len(shards), "k").select("path", "start").mapInArrow(lean(_read_shards), schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "path", "position"])


def read_at(path: str, numbers: list[int]) -> list[tuple[int | None, list[int]]]:
    """The records of these numbers of a shard, in that order, through its index."""
    import numpy as np

    store, name = _open(path)
    out = []
    with store.open_input_file(f"{name}.idx") as index, store.open_input_file(f"{name}.rec") as f:
        width = f.read(8)[5]
        for k in numbers:
            index.seek(k * _ENTRY.size)
            f.seek(_ENTRY.unpack(index.read(_ENTRY.size))[0])
            payload = unframe(f.read)
            key, null = _KEY.unpack(payload[:9])
            out.append((None if null else key, np.frombuffer(payload, f"<u{width}", offset=9).tolist()))
    return out


def _remove_leftovers(spark: SparkSession, uri: str) -> None:
    """Temporary files of attempts that failed: once all shards are written, none is in use."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(path(f"{uri}/.tmp-*")) or ():
        store.delete(found.getPath(), False)


def token_records(df: DataFrame, uri: str | None = None, **options) -> DataFrame:
    """Writes df's records and reads the files back, each shard's first start being the ids of all
    shards before it (the driver holds one row for each shard)."""
    spark = df.sparkSession
    uri = uri or scratch(spark, "records")
    shards = sorted((r.shard, r.path, r.n_tokens) for r in write_records(df, uri, **options).collect())
    _remove_leftovers(spark, uri)
    starts = [0, *accumulate(n for _, _, n in shards)]
    return read_records(spark, [(p, s) for (_, p, _), s in zip(shards, starts, strict=False)])
