"""The Jaccard join against all pairs."""

import random
import re

import pytest

from siteglass.llm import common, jaccard
from siteglass.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def truth(rows, n, num, den):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    above = {i: i for i in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both * den >= (len(sets[i]) + len(sets[j]) - both) * num:
                a, b = sorted((top(i), top(j)))
                above[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def families(rng, sizes, edits):
    """Texts in families of near copies whose similarities lie around the threshold."""
    vocabulary = [f"w{k}" for k in range(300)]
    out = []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for size in sizes:
        base = [rng.choice(vocabulary) for _ in range(size)]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(edits + 1) if words else 0):
                k = rng.randrange(max(1, len(words)))
                words[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w.upper() for w in words[k : k + 1]]])
            out.append(" ".join(words) or None)
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "num", "den", "seed"), [(3, 90, 100, 1), (5, 80, 100, 2), (2, 60, 100, 3)])
def test_equals_all_pairs(spark, n, num, den, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 4, 6, 9, 12, 20, 33, 60, 150, 400]) for _ in range(60)]
    rows = families(rng, sizes, 6) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "a"), (9005, "A"), (9006, "x y"), (9007, "word " * 5000), (9008, "word " * 4000)]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), n=n, num=num, den=den).collect()
    want = truth(rows, n, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows)


def test_defined_cases(spark):
    rows = [(1, "same text here now", "x"), (1, "same text here now", "y"), (None, "same text here now", "z"), (2, "same text here now", "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in jaccard.classes(df, n=3, num=90, den=100).collect())
    assert got == [(0, 0, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0)]
    kept = jaccard.representatives(df, n=3, num=90, den=100).collect()
    assert sorted((r.doc_id or 0, r.node) for r in kept) == [(0, "z"), (1, "x"), (1, "y"), (3, "x")]
    assert jaccard.classes(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(139, 200), (300, 301), (301, 300), (302, 302)]
    random.Random(4).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in [*range(100, 140), 200]}, 300: 300, 301: 300}


@pytest.mark.parametrize(("n", "num", "den", "seed"), [(3, 90, 100, 11), (5, 80, 100, 12)])
def test_links_of_each_document_against_all_pairs(spark, n, num, den, seed):
    rng = random.Random(seed)
    rows = families(rng, [rng.choice([4, 9, 20, 60, 150, 400]) for _ in range(30)], 6)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    for k in range(40):  # a family whose hub is far from the others
        words = ["hub", "of", "it", *base[12:]] if k == 0 else list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(5)}"
        rows.append((5000 + k, " ".join(words)))
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    kinds = set(sets.values())
    want = {i: sum(s != o and len(s & o) * den >= len(s | o) * num for o in kinds if s and o) for i, s in sets.items()}
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), n=n, num=num, den=den).collect()
    assert {r.doc_id: r.n_links for r in got} == want and max(want.values()) > 10


def test_split_keys(spark, monkeypatch):
    """Every key of more than two rows is dealt over several tasks."""
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    rng = random.Random(8)
    rows = families(rng, [9, 30, 90, 90, 200], 5)
    rows += [(1000 + k, rows[0][1]) for k in range(30)]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=80, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == truth(rows, 3, 80, 100)
