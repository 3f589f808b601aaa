"""The pipeline against plain versions of its stages, each on its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteglass.llm import decontamination, quality, toxicity
from siteglass.llm.bpe import PrefixCounter
from siteglass.llm.common import vocabulary_path

from .test_jaccard import truth
from .test_scans import plain_statistics

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF_DIR).cache())
    return frames


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert all(f.columns == stages[0].columns for f in stages[:-1])


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rules = quality.learn(stages[0], labels)
    want = []
    for r in stages[0].collect():
        s = dict(zip(quality.STATISTICS, plain_statistics(r.text), strict=True))
        n = max(1, s["n_words"])
        x = {"n_words": float(s["n_words"]), "word_length": s["word_chars"] / n, "symbols": s["n_symbols"] / n, "dup_lines": s["n_dup_lines"] / n, "repeats": s["n_repeat_words"] / n, "same_next": s["n_same_next"] / n}
        if not (s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"] or any(all(y.holds(x) for y in rule) for rule in rules)):
            want.append(r.doc_id)
    assert ids(stages[1]) == sorted(want)


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(stages[1], labels, usable=~toxicity.held_out(F.col("doc_id")))
    scorer = toxicity.Scorer(model.letters, model.weights)
    rows = stages[1].collect()
    scores = toxicity.probabilities([r.text for r in rows], scorer, model)
    assert ids(stages[2]) == sorted(r.doc_id for r, s in zip(rows, scores, strict=True) if s < 0.5)


def test_near_duplicates(stages):
    found = truth([(r.doc_id, r.text) for r in stages[2].collect()], 5, 80, 100)
    assert ids(stages[3]) == sorted(i for i, (_, top) in found.items() if i == top)


def test_decontamination(spark, stages):
    import re

    word = re.compile(r"[^\W\d_]+")
    grams = lambda t: {tuple(w[k : k + 8]) for w in [word.findall((t or "").lower())] for k in range(len(w) - 7)}
    items = [grams(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    gone = set(ids(stages[3])) - set(ids(stages[4]))
    for r in stages[3].collect():
        own = grams(r.text)
        share = max((len(own & i) / len(i) for i in items if i), default=0)
        assert (r.doc_id in gone) == (share >= 0.3), (r.doc_id, share)
    assert decontamination.WINDOW == 8


def test_packing(stages):
    library = PrefixCounter(vocabulary_path()).library
    tokens = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    pieces = stages[5].collect()
    held = {}
    for r in pieces:
        held.setdefault(r.doc_id, []).append((r.start, r.length))
        assert r.doc_tokens == tokens[r.doc_id]
    assert set(held) == set(tokens)
    for d, parts in held.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == tokens[d]
    assert corpus_pipeline.ORACLE_SQL is None


WORDS = " ".join(f"word{k}" for k in range(40))
LONG = " ".join(f"w{k % 9973}x{k // 9973}" for k in range(60_000))
#: Nulls in any column, empty and very long texts, repeated rows, equal texts, and columns that bear a stage's own names.
ROWS = [
    (1, None, "en", "a", 1), (2, "", None, "a", 1), (3, " \n\t", "en", None, 1), (4, LONG, "en", "a", None), (5, WORDS, "en", "a", 1), (6, WORDS, "de", "b", 1),
    (None, WORDS + " more", "en", "a", 1), (7, WORDS.replace("word3 ", "other "), "en", "a", 1), (7, WORDS.replace("word3 ", "other "), "en", "a", 1), (8, "short one", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, predicted string, node int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(5, 1, 0), (7, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a question that no document holds in any form at all, not even in part"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.createDataFrame(ROWS, SCHEMA), folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("k", "gone"), [(0, {1, 2, 3, 8}), (1, set()), (2, {6, 7}), (3, set())])
def test_defined_cases_of_each_filter(spark, odd, k, gone):
    docs, folder = odd
    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    assert out.columns == docs.columns
    assert rows_of(out) == sorted((r for r in ROWS if r[0] not in gone), key=repr)
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), folder).count() == 0


def test_defined_cases_of_packing(spark, odd):
    docs, folder = odd
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in ROWS}
    assert [r.length for r in pieces if r.doc_id in (1, 2)] == [1, 1] and sum(r.start == 0 for r in pieces if r.doc_id == 7) == 2
    assert sum(r.length for r in pieces if r.doc_id == 4) == next(r.doc_tokens for r in pieces if r.doc_id == 4)
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), folder).count() == 0
