"""A character trigram model counted over a whole table, and a lattice decoder that uses it."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import lean, ship

#: Letters of the model, in the order of their codes; code 0 is everything else, a word's border.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœßúùûüýÿ"
SIZE = 64
CODE = {c: k for k, c in enumerate(LETTERS, 1)}


def _table() -> np.ndarray:
    out = np.zeros(0x180, np.int64)
    for c, k in CODE.items():
        out[ord(c)] = k
    return out


def count_trigrams(texts: list[str | None]) -> np.ndarray:
    """Trigram counts of lower-cased texts, each with a border on both sides."""
    table = _table()
    joined = "  " + "  ".join(t.lower() for t in texts if t) + "  "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = table[np.where(points < len(table), points, 0)]
    grams = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
    out = np.bincount(grams, minlength=SIZE**3)
    out[0] = 0  # three borders say nothing about words
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        total += count_trigrams(batch.column(0).to_pylist())
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["gram", "n"])


def fit(df: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of the third letter given two, over all texts of df: SIZE**3 floats.

    Tasks send one row for each trigram they saw, so what reaches the driver is at most SIZE**3 rows.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(text)).mapInArrow(lean(_count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3, np.float64)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return log_probabilities(counts)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Trigrams backed off to bigrams and single letters by additive interpolation."""
    three = counts.reshape(SIZE, SIZE, SIZE)
    two = three.sum(0)
    one = two.sum(0)
    p1 = (one + 0.5) / (one.sum() + 0.5 * SIZE)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 20 * p2[None, :, :]) / (three.sum(2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32).ravel()


#: Costs, in nats, of what writers do to a word.
SUBSTITUTE, DROP_MARK, REPEAT, DOUBLE, MASK = 1.0, 0.7, 0.6, 3.0, 2.5
#: Characters that stand for letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
MARKS = "._-,~'`^/\\:;*"
#: Longer runs of characters are no words and stay as they are.
LONGEST = 256
#: From this many states on, a masked letter is worked out for all pairs of letters at once.
_DENSE = 40


class Decoder:
    """Viterbi decoding of one token's lattice: what letters the writer most likely meant.

    A letter stands for itself; a leet character for its letters; `*` for any one letter or for
    nothing; a mark for nothing; a letter equal to the one before may be a repetition and stand for
    nothing, readily in runs of three or more. States are the last two letters, all of them (at most
    SIZE * SIZE): the search is exact. Ties go to the reading found first.
    """

    def __init__(self, model: np.ndarray) -> None:
        self.cube = model.astype(np.float64).reshape(SIZE, SIZE, SIZE)
        self.p = self.cube.ravel().tolist()

    def decode(self, token: str) -> str | None:
        """The most likely letters of the token, or None if it has a character outside the lattice or
        more than LONGEST of them."""
        if len(token) > LONGEST:
            return None
        p = self.p
        # by the codes of the last two letters: score, and the reading as (reading before, letter)
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        before = ""
        for at, c in enumerate(token):
            if c in CODE:
                options = [(c, 0.0)]
            elif c in LEET:
                options = [(x, SUBSTITUTE) for x in LEET[c]]
            elif c == "*":
                options = [(x, MASK) for x in LETTERS[:26]]
            elif c in MARKS:
                before = c
                continue  # all readings drop it at the same cost
            else:
                return None
            drop = DROP_MARK if c == "*" else None
            if drop is None and c == before:
                drop = REPEAT if token[at - 2 : at] == c + c or token[at : at + 2] == c + c else DOUBLE
            new: dict[int, tuple[float, tuple | None]] = {}
            if c == "*" and len(states) > _DENSE:
                new = self._masked(states)
            else:
                for ab, (score, path) in states.items():
                    for x, cost in options:
                        k = CODE[x]
                        s, to = score - cost + p[ab * SIZE + k], ab % SIZE * SIZE + k
                        if to not in new or new[to][0] < s:
                            new[to] = (s, (path, x))
            if drop is not None:
                for ab, (score, path) in states.items():
                    if ab not in new or new[ab][0] < score - drop:
                        new[ab] = (score - drop, path)
            states = new
            before = c
        path = max(((s + p[ab * SIZE], path) for ab, (s, path) in states.items()), key=lambda z: z[0])[1]
        out = []
        while path is not None:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def _masked(self, states: dict[int, tuple[float, tuple | None]]) -> dict[int, tuple[float, tuple | None]]:
        """The states after one letter that may be any."""
        scores = np.full(SIZE * SIZE, -np.inf)
        scores[list(states)] = [s for s, _ in states.values()]
        ends = sorted({ab % SIZE for ab in states})
        found = scores.reshape(SIZE, SIZE)[:, ends, None] + self.cube[:, ends, 1:27]
        first = found.argmax(0)
        best = np.take_along_axis(found, first[None], 0)[0] - MASK
        new = {}
        for j, b in enumerate(ends):
            for k, (s, a) in enumerate(zip(best[j].tolist(), first[j].tolist(), strict=True), 1):
                new[b * SIZE + k] = (s, (states[a * SIZE + b][1], LETTERS[k - 1]))
        return new


_EDGE = re.compile(r"^[^\w@$€£]+|[^\w@$€£]+$")
_LETTER = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[^\W\d_]*[0-9@$!|+€£*][^\W\d_]|[^\W\d_][0-9@$!|+€£*]|([^\W\d_])\1\1|[^\W\d_][._~^*-][^\W\d_][._~^*-][^\W\d_]")
#: Three or more single characters, one space or mark between each two.
SPACED = re.compile(r"(?<!\S)(?:[^\s\d][ \t]){2,}[^\s](?!\S)")


def restore_word(word: str, decoder: Decoder) -> str:
    """A lower-cased word without the marks around it, deobfuscated if it looks obfuscated."""
    core = word if word.isalpha() else _EDGE.sub("", word)
    core = re.sub(r"^[@$€£]{2,}|[@$€£]{2,}$", "", core)
    if not core or not _ODD.search(core):
        return core
    if not _LETTER.search(core):
        return core
    found = decoder.decode(core)
    return core if found is None else found


def respace(text: str, decoder: Decoder) -> str:
    """Joins letters that were spaced out, each run decoded as one word."""
    return SPACED.sub(lambda m: decoder.decode("".join(m[0].split())) or m[0], text)


def perplexity(word: str, model: np.ndarray) -> float:
    a = b = 0
    total = 0.0
    for c in [*word, ""]:
        k = CODE.get(c, 0)
        total -= float(model[(a * SIZE + b) * SIZE + k])
        a, b = b, k
    return math.exp(total / (len(word) + 1))
