"""Token counts by prefix dynamic programming.

`token_counts` appends the exact number of tokens of each whole text and what a budget question
needs; `prefix_counts` appends the whole table of a text (tokens of every prefix), so that any later
truncation or budget question is an array lookup. Both are narrow: one pass, no shuffle.

Time is in proportion to a text's length, also where it is one long run of white space or of one letter,
or full of special strings: only the pre-tokens around a budget have their tables looked into.

Null and empty texts have 0 tokens; a repeated row is answered once for each repeat; an empty table
gives an empty table; other columns pass through untouched, whatever their names, unless they bear
the name of a result column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteglass.llm.bpe import PrefixCounter
from siteglass.llm.common import lean, per_worker, ship, vocabulary_path

_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens", "fit_chars")])


def _with(df: DataFrame, new: T.StructType, text: str, make) -> DataFrame:
    """df and the new columns, which `make` computes from the texts of an Arrow batch."""
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in new.names]
    base = df if text not in new.names else df.withColumn("__text", F.col(text))
    source = text if text not in new.names else "__text"
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = make()  # the worker's own counter, in use for as long as batches come
            texts = batch.column(batch.schema.get_field_index(source)).to_pylist()
            columns = work(texts)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + columns, names=[*names, *new.names])

    return base.select(*dict.fromkeys([*names, source])).mapInArrow(lean(run), T.StructType([*kept, *new.fields]))


def token_counts(df: DataFrame, text: str = "text", vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens, fit_chars (the longest prefix, in characters, of at most
    `limit` tokens) and over_limit."""
    path = vocabulary or vocabulary_path()

    def make():
        counter = per_worker(lambda: PrefixCounter(path), ("prefix", path))

        def work(texts: list[str | None]) -> list[pa.Array]:
            fits = counter.fitting_many(texts, limit)
            sizes = [len(t) if t and t.isascii() else len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            return [pa.array(sizes, pa.int64()), pa.array([n for n, _ in fits], pa.int64()), pa.array([k for _, k in fits], pa.int64())]

        return work

    return _with(df, _COUNTS, text, make).withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """df with prefix_tokens: for each length in characters, from 0 to the whole text, the tokens
    of the prefix of that length. element_at(prefix_tokens, k + 1) answers for text[:k]."""
    path = vocabulary or vocabulary_path()

    def make():
        counter = per_worker(lambda: PrefixCounter(path), ("prefix", path))
        return lambda texts: [pa.array([counter.prefixes(t) for t in texts], pa.list_(pa.int32()))]

    return _with(df, T.StructType([T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))]), text, make)
