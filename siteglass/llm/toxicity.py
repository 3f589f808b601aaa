"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. A character trigram model is counted over all texts of the table (`char_model.fit`).
2. Words that look obfuscated (leet characters or marks among letters, letters repeated three times
   or more, letters spaced out) are Viterbi-decoded under that model; other words stay as they are.
3. A lexicon of word and word-beginning features is learned from a bounded sample of labelled rows
   (at most `most_rows`, those of smallest hash): each feature's log ratio of document frequencies in
   toxic and other rows, kept if frequent and strong.
4. A small logistic regression turns the lexicon hits of a restored text into a score; it is fitted on
   hits counted by a lexicon from the other half of the sample, so that it does not trust the
   lexicon's own rows too far.

Scoring is one narrow pass. Scores use the text alone. Null and empty texts have no hits and get the
score of that; very long texts are read whole, but a run of more than char_model.LONGEST characters without
white space (or of letters spaced out) is no word and not decoded. Rows with a null doc_id are scored as
others; whether they are held out is null. Labelled rows of one class only give a lexicon without entries and one score for all.
Repeated rows get equal results; an empty table gives an empty table; columns named like a result are
replaced, others pass through.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteglass.llm import char_model
from siteglass.llm.common import in_use, lean, per_worker, ship, stored
from siteglass.llm.word_table import WordTable, pieces, points_of, word_spans

BITS = 20
#: Lengths of word beginnings that are features besides the whole word.
STEMS = range(4, 9)
#: A feature counts if that many toxic rows hold it, and it is that much likelier in them.
LEAST_ROWS, LEAST_RATIO = 3, 4.0


@dataclass
class Model:
    """What scoring needs: the character model, lexicon weights by feature hash, the regression."""

    letters: np.ndarray
    weights: dict[int, float]
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    token: str


class Reader:
    """Numbers the distinct words of texts; a word's restored features are worked out once."""

    def __init__(self, letters: np.ndarray, most_words: int = 1_500_000) -> None:
        self.decoder = char_model.Decoder(letters)
        self.table = WordTable(most_words, lambda points: word_spans(points)[0])

    def features(self, word: str) -> tuple[int, ...]:
        """Hashes of the restored word and of its beginnings; none for what has no letter."""
        x = char_model.restore_word(word, self.decoder)
        if not any(map(str.isalpha, x)):
            return ()
        return (hash_of(f"^{x}$"), *(hash_of(f"^{x[:k]}") for k in STEMS if k < len(x)))

    def lowered(self, text: str | None) -> str:
        """What words are cut from: lower case, spaced-out words joined; U+0000 parts words too."""
        if not text:
            return ""
        lower = text.lower()
        if "\0" in lower:
            lower = lower.replace("\0", " ")
        return char_model.respace(lower, self.decoder) if char_model.SPACED.search(lower) else lower

    def read(self, texts: list[str | None], learn: Callable[[list[str]], None], forget: Callable[[], None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Groups of texts: their numbers, the number of each word in them, and each text's end among
        the words. `learn` gets new words in the order of their numbers; `forget` resets what it keeps."""
        lowered = [self.lowered(t) for t in texts]
        for group in pieces(lowered):
            joined = "\0".join([lowered[g] for g in group]) + "\0"
            if self.table.n > self.table.most_words:
                self.table.clear()
                forget()
            points = points_of(joined)
            starts, ends = word_spans(points)
            numbers = self.table.look_up(points, starts, ends)
            new = self.table.add(numbers)
            if len(new):
                learn([joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            yield group, numbers, np.searchsorted(starts, np.flatnonzero(points == 0))


def hash_of(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Scorer:
    """The regression's inputs for texts, by the weight of each distinct word: the largest of its
    features' weights."""

    def __init__(self, letters: np.ndarray, weights: dict[int, float]) -> None:
        self.reader, self.weights = Reader(letters), weights
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(1 << 16)
        self.n = 0

    def learn(self, words: list[str]) -> None:
        get, features = self.weights.get, self.reader.features
        while self.n + len(words) > len(self.known):
            self.known = np.concatenate((self.known, np.zeros_like(self.known)))
        self.known[self.n : self.n + len(words)] = [max([get(f, 0.0) for f in features(w)], default=0.0) for w in words]
        self.n += len(words)

    def inputs(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 6))
        for group, numbers, ends in self.reader.read(texts, self.learn, self.forget):
            weights = self.known[numbers]
            firsts = np.concatenate(([0], ends[:-1]))
            at = np.flatnonzero(weights)
            low, high = np.searchsorted(at, firsts), np.searchsorted(at, ends)
            sums = np.concatenate(([0.0], np.cumsum(weights[at])))
            n, total, words = high - low, sums[high] - sums[low], ends - firsts
            most = np.array([weights[at[a:b]].max() if b > a else 0.0 for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            total = np.where(n > 0, total, 0.0)
            out[group] = np.column_stack((np.ones(len(group)), np.log1p(n), most, np.log1p(np.maximum(total, 0)), total / np.sqrt(np.maximum(1, words)), np.log1p(words)))
        return out


def lexicon(counts: dict[int, list[int]], rows: list[int]) -> dict[int, float]:
    """Weights of features by the numbers of rows with label 0 and 1 that hold them."""
    if not all(rows):
        return {}
    out = {}
    for f, (other, toxic) in counts.items():
        ratio = math.log((toxic + 0.1) / (rows[1] + 1)) - math.log((other + 1) / (rows[0] + 1))
        if toxic >= LEAST_ROWS and ratio >= math.log(LEAST_RATIO):
            out[f] = ratio
    return out


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a ridge logistic regression by Newton's method; column 0 is 1."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    z, beta = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta)), z.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _frequencies(batches: Iterator[pa.RecordBatch], letters, wanted) -> Iterator[pa.RecordBatch]:
    """From (text, label, half): in how many rows of each label and half each feature is held, of all
    features or of the wanted ones; feature -1 counts the rows."""
    reader = Reader(letters.value)
    only = wanted.value if wanted is not None else None
    known: list[tuple[int, ...]] = []
    held: Counter[tuple[int, int, int]] = Counter()

    def learn(words: list[str]) -> None:
        for w in words:
            f = reader.features(w)
            known.append(f if only is None else tuple(x for x in f if x in only))

    for batch in batches:
        texts, labels, halves = (c.to_pylist() for c in batch.columns)
        for group, numbers, ends in reader.read(texts, learn, known.clear):
            first = 0
            for g, end in zip(group, ends.tolist(), strict=True):
                y, h = labels[g], halves[g]
                found = set().union(*map(known.__getitem__, np.unique(numbers[first:end]).tolist()))
                first = end
                held[-1, y, h] += 1
                held.update([(f, y, h) for f in found])
    rows = list(held.items())
    for k in range(0, len(rows), 50_000):
        part = rows[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in part], pa.int32()), pa.array([x[0][1] for x in part], pa.int32()), pa.array([x[0][2] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int64())], names=["feature", "label", "half", "n"])


def _inputs(batches: Iterator[pa.RecordBatch], letters, lexica) -> Iterator[pa.RecordBatch]:
    """From (text, label, half): the regression's inputs by the lexicon of the other half."""
    scorers = [Scorer(letters.value, x) for x in lexica.value]
    for batch in batches:
        texts, labels, halves = (c.to_pylist() for c in batch.columns)
        x = np.where(np.array(halves)[:, None] == 0, scorers[1].inputs(texts), scorers[0].inputs(texts))
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])


def learn(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", usable: Column | None = None, most_rows: int = 12_000) -> Model:
    """Learns from at most `most_rows` labelled rows for which `usable` (a condition on doc_id) holds.

    The driver holds the character model, the features that at least LEAST_ROWS toxic rows of the
    sample hold, and six numbers for each sampled row.
    """
    spark = df.sparkSession
    ship(spark)
    letters = char_model.fit(df, text)
    shared = spark.sparkContext.broadcast(letters)
    key = F.col(doc_id)
    sample = labels.where(key.isNotNull() & F.col(label).isin(0, 1))
    sample = sample.where(usable) if usable is not None else sample
    sample = sample.groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64(key), key).limit(most_rows)
    chosen = stored(df.select(key, F.col(text).alias("text")).join(F.broadcast(sample), doc_id).select("text", "label", F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)).cast("int").alias("half")), "toxic-sample")
    schema = "feature int, label int, half int, n long"

    def summed(rows: DataFrame, wanted) -> DataFrame:
        found = rows.mapInArrow(lean(lambda batches: _frequencies(batches, shared, wanted)), schema)
        return found.groupBy("feature", "label", "half").agg(F.sum("n").alias("n"))

    toxic = summed(chosen.where("label = 1"), None)
    often = toxic.groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS).select("feature")
    wanted = frozenset(r["feature"] for r in often.collect())
    both = summed(chosen, spark.sparkContext.broadcast(wanted))
    counts: list[dict[int, list[int]]] = [{}, {}, {}]
    for r in both.collect():
        for side in (r["half"], 2):
            counts[side].setdefault(r["feature"], [0, 0])[r["label"]] += r["n"]
    rows = [c.pop(-1, [0, 0]) for c in counts]
    lexica = [lexicon(c, n) for c, n in zip(counts, rows, strict=True)]
    halves = spark.sparkContext.broadcast(lexica[:2])
    found = chosen.mapInArrow(lean(lambda batches: _inputs(batches, shared, halves)), "label int, x array<double>").collect()
    found = sorted((r["label"], r["x"]) for r in found)
    y, x = np.array([y for y, _ in found], float), np.array([x for _, x in found]).reshape(len(found), 6)
    if len(y) and 0 < y.sum() < len(y):
        mean, scale, beta = regression(x, y)
    else:
        share = float(y.mean()) if len(y) else 0.0
        mean, scale, beta = np.zeros(6), np.ones(6), np.array([math.log((share + 1e-3) / (1 - share + 1e-3)), 0, 0, 0, 0, 0])
    return Model(letters, lexica[2], mean, scale, beta, uuid.uuid4().hex)


def probabilities(texts: list[str | None], scorer: Scorer, model: Model) -> np.ndarray:
    z = ((scorer.inputs(texts) - model.mean) / model.scale) @ model.beta
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(batches: Iterator[pa.RecordBatch], model, names: list[str]) -> Iterator[pa.RecordBatch]:
    m = model.value
    scorer = per_worker(lambda: Scorer(m.letters, m.weights), ("toxicity", m.token))
    for batch in batches:
        in_use()
        scores = probabilities(batch.column(batch.num_columns - 1).to_pylist(), scorer, m)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*names, "score"])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 from 0.5)."""
    spark = df.sparkSession
    ship(spark)
    kept = [f for f in df.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    shared = spark.sparkContext.broadcast(model)  # bounded: 64**3 floats and at most 2**BITS weights
    out = df.select(*names, F.col(text).alias("__text")).mapInArrow(lean(lambda batches: _score(batches, shared, names)), T.StructType([*kept, T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
