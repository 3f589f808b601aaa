"""Cost-balanced packing of token pieces into sequences of one capacity.

Each task takes its documents in windows of a fixed number of tokens. In a window, whole
capacity-long pieces of a document become full sequences; what is left of each document is a
remainder. The window opens just as many further sequences as the remainders' tokens need. Then the
remainders, in descending length (ties: document order), go to the sequence of lowest estimated cost
(linear + quadratic attention) with room for all of it. One that no sequence has room for is cut over
the sequences with most room. So only a window's last sequences hold padding: less than one capacity
for each window. A sequence whose length is a power of two is not padded.

A task's memory is one window; nothing is shuffled. A task that is run again reads the same split
and so gives the same sequences. Null and empty texts are a single end id. Repeated rows are packed
as often as they occur; an empty table gives an empty table; other columns are not read. A null
doc_id stays null.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siteglass.llm.bpe import WordEncoder
from siteglass.llm.common import in_use, lean, per_worker, ship, vocabulary_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
#: A window of this many tokens: its ids take four bytes each.
WINDOW_TOKENS = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int, int]]]:
    """The sequences of one window: lists of (document's index, start, length, offset)."""
    full, rest = [], []
    for i, n in enumerate(lengths):
        for k in range(n // capacity):
            full.append([(i, k * capacity, capacity, 0)])
        if n % capacity:
            rest.append((n % capacity, i, n - n % capacity))
    total = sum(n for n, _, _ in rest)
    open_: list[list[tuple[int, int, int, int]]] = [[] for _ in range(-(-total // capacity))]
    room = [capacity] * len(open_)
    if open_:
        room[-1] -= (-total) % capacity  # the last one is as short as the tokens allow
    cost = [0.0] * len(open_)
    # sequences by cost; those without room for the piece at hand wait, as later pieces are no longer
    by_cost = [(0.0, s) for s in range(len(open_))]
    heapq.heapify(by_cost)
    waiting: list[tuple[int, int]] = []  # (-room, sequence): the next pieces are smaller and may fit again

    def put(s: int, i: int, start: int, n: int) -> None:
        at = sum(x[2] for x in open_[s])
        open_[s].append((i, start, n, at))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n, i, start in sorted(rest, key=lambda x: (-x[0], x[1], x[2])):
        while waiting and -waiting[0][0] >= n:
            _, s = heapq.heappop(waiting)
            heapq.heappush(by_cost, (cost[s], s))
        while by_cost:
            _, s = by_cost[0]
            if room[s] >= n:
                break
            heapq.heappop(by_cost)
            if room[s]:
                heapq.heappush(waiting, (-room[s], s))
        if by_cost:
            heapq.heappop(by_cost)
            put(s, i, start, n)
            if room[s]:
                heapq.heappush(by_cost, (cost[s], s))
            continue
        while n:  # no sequence has room for all of it
            _, s = heapq.heappop(waiting)
            part = min(n, room[s])
            put(s, i, start, part)
            n, start = n - part, start + part
            if room[s]:
                heapq.heappush(waiting, (-room[s], s))
    return full + [x for x in open_ if x]


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = 1024, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start and length in the document's ids, their CRC-32,
    doc_tokens, sequence_id, offset in the sequence, and the piece's estimated cost."""
    ship(df.sparkSession)
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoder = per_worker(lambda: WordEncoder(path), ("encode", path))
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        end = encoder.pack([end_id])
        ids: list[bytes] = []
        docs: list[int | None] = []
        held = made = 0
        width = encoder.width

        def window() -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            rows = []
            wide = [np.frombuffer(x, f"<u{width}").astype("<u4") for x in ids]
            for sequence in assign([len(x) for x in wide], capacity):
                for i, start, n, offset in sequence:
                    rows.append((docs[i], start, n, zlib.crc32(wide[i][start : start + n].data), len(wide[i]), first + made, offset, LINEAR * n + QUADRATIC * n * n))
                made += 1
            ids.clear()
            docs.clear()
            held = 0
            for k in range(0, len(rows), 20_000):
                part = list(zip(*rows[k : k + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if j == 7 else pa.int64()) for j, c in enumerate(part)], names=NAMES)

        for batch in batches:
            in_use()
            for d, x in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist()), strict=True):
                ids.append(x + end)
                docs.append(d)
                held += len(x) // width + 1
                if held >= window_tokens:
                    yield from window()
        yield from window()

    return df.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(lean(run), SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
