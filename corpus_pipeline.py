"""A training corpus from raw documents: quality, toxicity, near duplicates, leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs are all rows that the stage before
it kept, and every stage but the last returns the columns of documents. Labels and benchmark come from
sf_dir; models are learned from the labelled rows that are left in docs.

Every stage reads whole texts, however long, and the columns doc_id and text alone; other columns pass through
(packing does not read them), also where they are null or bear a name that the stage uses inside. Repeated rows
are judged each, and alike. Empty tables give empty tables. Null labels and labels of null documents are not
learned from; without labels of both kinds nothing is rejected by them. What a stage does with null and empty texts,
null ids and ties is said with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm import decontamination, jaccard, packing, quality, toxicity
from siteglass.llm.common import scratch_scope, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base test and the learned rules keep. Null, empty and wordless texts fail the base
    test and go; a null doc_id is judged as any other. Ties between rules: the first in order decides."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.learn(docs, labels))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents not predicted to be toxic; learned without the rows that op6 holds out. Null and empty texts
    have no toxic word and stay, as do rows with a null doc_id that are not predicted to be toxic; a score of just
    one half is toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels, usable=~toxicity.held_out(F.col("doc_id")))
    columns = docs.columns
    row = docs.select(F.struct(*columns).alias("row"), "text")
    return toxicity.score(row, model).where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over 5-word shingles: its smallest id, all
    rows of it. Null, empty and wordless texts are linked with nothing and stay; rows with a null doc_id stay."""
    return jaccard.representatives(docs, n=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no benchmark item. Null and empty texts leak nothing; null and empty items, and
    those of fewer than five words (decontamination.unchecked), are not looked for."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 1024 tokens. A null or empty text is its end id
    alone; a null doc_id stays null; documents of equal length are taken in the order of their rows."""
    return packing.pack(docs, end_id=0, capacity=1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("packing", pack),
]

#: SQL has no tokenizer, no learned rules and no decoder; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"))
    return STAGES[-1][1](spark, docs, sf_dir)
