"""Quality rules, toxicity, licences and URL filters against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteglass.llm import char_model, licenses, quality, toxicity, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a b c d e f g h i j", "same line\nsame line\n \nsame line\r\nx", "a a a a a a a a a a a a", "# $ % ^ & | < > *", "é ü 漢字 🙂  x " * 4, "w " * 20_000, " ".join(map(str, range(3000)))]


def plain_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    counts = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = set()
    for k in range(len(words) - 4):
        if counts[tuple(words[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), sum(a == b for a, b in zip(words, words[1:], strict=False)))


def test_statistics(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("ab c\n d# e".split(" ")) for _ in range(rng.randrange(80))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, n_words string")
    got = {r.doc_id: tuple(r[c] for c in quality.STATISTICS) for r in quality.statistics(df).collect()}
    assert got == {**{k: plain_statistics(t) for k, t in enumerate(texts)}, None: plain_statistics("no id")}
    assert quality.statistics(df.limit(0)).count() == 0


def test_rules_are_learned_and_kept(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 80))]
        bad = k % 4 == 0
        rows.append((k, " ".join(w + "###" * bad for w in words), "s"))
        labels.append((k, int(not bad)))
    df = spark.createDataFrame([*rows, (None, None, "s"), (1000, "", "s")], "doc_id long, text string, kept string")
    rules = quality.learn(df, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int"))
    assert rules
    got = {r.doc_id: (r.kept, r.rule) for r in quality.judge(df, rules).collect()}
    assert all(got[k][0] == (k % 4 != 0) for k in range(400)) and got[None][0] is False and got[1000][0] is False
    kept = quality.keep(df, rules)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [k for k in range(400) if k % 4]
    assert quality.learn(df, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert quality.judge(df.limit(0), []).count() == 0


def test_cover_equals_the_rows_it_claims():
    rows = [({"a": float(k % 10), "b": float(k % 7)}, k % 10 >= 8 or k % 7 == 0) for k in range(700)]
    rules = quality.cover(rows, ["a", "b"])
    assert all(any(all(x.holds(v) for x in r) for r in rules) == bad for v, bad in rows)


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(3)
    words = "the a of idiot stupid moron loser trash worthless good green house water paper morning evening".split()
    return char_model.log_probabilities(char_model.count_trigrams([" ".join(rng.choice(words) for _ in range(3000))]).astype(float))


def test_decoding(letters):
    d = char_model.Decoder(letters)
    for written, meant in (("1d10t", "idiot"), ("id!ot", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("st*pid", "stupid"), ("$tupid", "stupid"), ("tr4sh,", "trash"), ("paper", "paper"), ("2024", "2024"), ("water***", "water"), ("", "")):
        assert char_model.restore_word(written, d) == meant
    assert char_model.respace("you i d i o t and s t u p i d", d) == "you idiot and stupid"


def every_reading(token):
    """All readings of a token with their costs, without any search."""
    readings = [("", 0.0)]
    for at, c in enumerate(token):
        if c in char_model.CODE:
            options = [(c, 0.0)]
        elif c in char_model.LEET:
            options = [(x, 1.0) for x in char_model.LEET[c]]
        elif c == "*":
            options = [(x, 2.5) for x in "abcdefghijklmnopqrstuvwxyz"] + [("", 0.7)]
        else:
            options = [("", 0.7)]
        if c not in char_model.MARKS and at and token[at - 1] == c:
            run = len(re.match(re.escape(c) + "*", token[at:])[0]) + len(re.search(re.escape(c) + "*$", token[:at])[0])
            options.append(("", 0.6 if run > 2 else 3.0))
        readings = [(r + x, cost + more) for r, cost in readings for x, more in options]
    return readings


def test_decoding_equals_all_readings():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("idiot entre extra enuxtre water fork funk stab stub scum ou et".split()) for _ in range(60)) for _ in range(20)]
    model = char_model.log_probabilities(char_model.count_trigrams(texts).astype(float)).astype(float)

    def score(reading, cost):
        codes = [0, 0, *(char_model.CODE[x] for x in reading), 0]
        return sum(model[(a * 64 + b) * 64 + c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)) - cost

    d = char_model.Decoder(char_model.log_probabilities(char_model.count_trigrams(texts).astype(float)))
    tokens = ["*en**xtre", "f**k", "s**b", "***m", "1d*0*", "wa**r", "f***", "aa**a", "s-c.u_m", "iddiiot", "$7*b", "!!!d**t"]
    tokens += ["".join(rng.choice("abeiotu013*-") for _ in range(6)) for _ in range(60)]
    for t in tokens:
        if t.count("*") > 3:
            continue
        best = max(score(r, c) for r, c in every_reading(t))
        found = d.decode(t)
        assert max(score(r, c) for r, c in every_reading(t) if r == found) >= best - 1e-6, t
    assert d.decode("x" * 257) is None and d.decode("**a" * 80) is not None


def test_toxicity(spark):
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in ("gre", "hou", "wat", "pap", "mor") for b in ("en", "se", "er", "ning", "la")]
    rows, labels = [], []
    for k in range(500):
        words = [rng.choice(plain) for _ in range(rng.randrange(30, 120))]
        if k % 5 == 0:
            for w in ("idiot", "moron", "scumbag"):
                words.insert(rng.randrange(len(words)), w)
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    hidden = [(9000, "greenla 1d10t wathouse m0r0n papla s c u m b a g " + " ".join(plain)), (9001, " ".join(plain * 3)), (9002, None), (9003, ""), (9004, "x" * 50_000), (None, "idiot moron scumbag " * 3)]
    df = spark.createDataFrame(rows + hidden, "doc_id long, text string").selectExpr("*", "'clash' score")
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"), usable=~toxicity.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(got) == 506 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[k].predicted == y for k, y in labels) >= 0.98 * len(labels)
    assert [got[k].predicted for k in (9000, 9001, 9002, 9003, 9004, None)] == [1, 0, 0, 0, 0, 1]
    none = toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(df.limit(5), none).collect()} == {0}
    assert toxicity.score(df.limit(0), none).count() == 0


def test_trigrams_count_all_texts(spark):
    texts = ["abc def", None, "", "ÀB c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert np.allclose(char_model.fit(df), char_model.log_probabilities(char_model.count_trigrams([t for t in texts if t]).astype(float)))


def plain_licenses(text):
    best = Counter()

    def dice(words, theirs):
        ours = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        return 2 * len(ours & theirs) / (len(ours) + len(theirs)) if ours else 0

    def normal(x):
        return re.sub("[^a-z0-9]+", " ", x.lower()).replace("licence", "license").split()

    for unit in re.split(r"[.!?]*[ \t\r]*\n\s*|[.!?]+\s+", text or ""):
        fits = {}
        for spdx, kind, theirs in licenses.templates():
            if kind == "notice" and (d := dice(normal(unit), theirs)) >= licenses.THRESHOLD:
                fits[spdx] = max(fits.get(spdx, 0), d)
        best.update(spdx for spdx, d in fits.items() if d == max(fits.values()))
    words, anchors, hits = normal(text or ""), licenses.anchors("whole"), set()
    for spdx, notice in licenses.notices().items():
        whole = normal(notice)
        theirs = {f"{a} {b}" for a, b in zip(whole, whole[1:], strict=False)}
        for start in {k - j for k, w in enumerate(words) if w in anchors for j, x in enumerate(whole) if x == w}:
            if (d := dice(words[max(0, start) : start + len(whole)], theirs)) >= licenses.THRESHOLD:
                hits.add((spdx, start, start + len(whole), d))
    for spdx, start, end, d in hits:
        others = [h for h in hits if h[1] < end and start < h[2]]
        best[spdx] += not any(h[3] > d or (h[3] == d and h[0] == spdx and h[1] < start) for h in others)
    return {spdx: n for spdx, n in best.items() if n}


def test_every_licence_has_a_whole_notice():
    assert set(licenses.notices()) == set(licenses.NAMES)
    for spdx, text in licenses.notices().items():
        assert plain_licenses(text).get(spdx), spdx


def test_licenses(spark):
    mit = licenses.WHOLE["MIT"]
    notices = licenses.notices()
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice("the of some software code file people terms any license conditions use write read".split()) for _ in range(n))
    embedded = [prose(300) + ".\n" + "\n".join(re.findall(r".{1,70}(?:\s|$)", notices[x])) + "\n" + prose(200) for x in notices]
    edited = [prose(40) + " " + " ".join(w for w in notices[x].split() if rng.random() > 0.04) + " " + prose(40) for x in ("MIT", "Apache-2.0", "BSD-3-Clause")]
    texts = [*ODD, *embedded, *edited, mit + "\n\n" + notices["ISC"] + " " + prose(30) + " " + mit, "Some text. Released under the MIT License.\nMore of it", "Licenced under the Apache Licence, Version 2.0!", "THIS WORK IS LICENSED UNDER CC BY-NC 4.0", mit, mit[:900], "prose " * 500 + "\nLicensed under the GNU General Public License, version 3.", "A licence is a document under which one may fish.", "Released under the MIT License.\nReleased under the MIT License."]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.n_matches
    assert got == {k: x for k, t in enumerate(texts) if (x := plain_licenses(t))}
    assert all(spdx in got[len(ODD) + k] for k, spdx in enumerate(notices))
    both = got[len(ODD) + len(embedded) + len(edited)]
    assert both["MIT"] == 2 and both["ISC"] == 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.net/en/1", "http://a.example.net/en", "https://x.net", "https://x.net/", "https://xnet/", "http://b.example.com/de/x?y#z", "http://example.com/DE/", "http://foo.org/fr/#a", "http://foo.org?/fr/", "https://www.cheap-pills.example.com/a", "https://spam.farm.test/", "https://myspam-farm.test/", "https://spam-farm.example.net/en/9", "ftp://casino.org/fr/", "http://u@net/", "http://net/", "http://" + "a." * 5000 + "net/"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(3, urls[3], "x")], "page_id long, url string, verdict string")
    rows = url_filters.judge(df).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) + 1

    def plain(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0].translate({c: c + 32 for c in range(65, 91)})
        path = re.split("[?#]", rest[len(host) :])[0]
        fit = [r for r in url_filters.DOMAIN_RULES for h, _, p in [r.name.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        if fit:
            r = max(fit, key=lambda r: len(r.name))
            return host, path, r.name, r.verdict
        hit = any(re.match(r.regex, host + path, re.S) for r in url_filters.PATTERN_RULES)
        return host, path, None, "block" if hit else "allow"

    assert got == {k: plain(u) for k, u in enumerate(urls)}
    assert url_filters.judge(df.limit(0)).count() == 0


def test_thousands_of_rules_equal_running_all(spark):
    rng = random.Random(13)
    syllables = ["ba", "do", "ki", "lu", "me", "ra", "so", "tu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4)))
    rules = tuple(dict.fromkeys(url_filters.word_rule(*(word() for _ in range(rng.randrange(1, 3))), verdict=rng.choice(["block", "allow"])) for _ in range(4000)))
    rules += tuple(url_filters.domain_rule(f"{word()}.net/{word()}/", "block") for _ in range(1000)) + (url_filters.Rule("no token", "block", r"[^/]*--[^/]*/.*", ()),)
    urls = [f"https://{rng.choice([word() + '.', '', 'x--'])}{word()}{rng.choice('.-_')}{word()}.{rng.choice(['net', 'test'])}/{rng.choice([word() + '/', ''])}p?{word()}" for _ in range(600)]
    urls += ["http://" + "ba" * 100_000 + ".net/", "http://h.test/" + "x/" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.pattern, r.verdict) for r in url_filters.judge(df, rules).collect()}
    compiled = [(r, re.compile(r.regex, re.S)) for r in rules]
    for k, u in enumerate(urls):
        whole = "".join(url_filters.host_and_path(u))
        fit = [r for r, x in compiled if x.match(whole)]
        domain = max((r for r in fit if r.literal), key=lambda r: len(r.literal), default=None)
        pattern = next((r for r in fit if not r.literal), None)
        want = (domain.name, None, domain.verdict) if domain else (None, pattern.name, pattern.verdict) if pattern else (None, None, "allow")
        assert got[k][2] == want[2] and (got[k][:2] == want[:2] or domain), u
    assert len({v for _, _, v in got.values()}) == 2 and sum(r is not None or p is not None for r, p, _ in got.values()) > 100


def test_scores_equal_a_plain_version(spark):
    """Lexicon, inputs and regression worked out again, word by word and by gradient steps."""
    import math
    import zlib

    rng = random.Random(21)
    plain = [f"{a}{b}" for a in ("gre", "hou", "wat", "pap", "mor", "tre") for b in ("en", "se", "er", "ning", "la")]
    bad = ["scumbag", "m0r0n", "idiot", "stuuupid", "trash", "w*rthless"]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if toxic else rng.random() < 0.1):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame([*rows, (999, None), (998, "")], "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"), usable=~toxicity.held_out(F.col("doc_id")))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}

    sample = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5]
    half = {r.doc_id: r.h for r in df.selectExpr("doc_id", "cast(pmod(xxhash64('half', doc_id), 2) as int) h").collect()}
    decoder = char_model.Decoder(model.letters)
    texts, y = dict(rows), dict(labels)

    def features(word):
        x = char_model.restore_word(word, decoder)
        found = [f"^{x}$", *(f"^{x[:n]}" for n in range(4, 9) if n < len(x))] if any(map(str.isalpha, x)) else []
        return {zlib.crc32(f.encode()) % (1 << 20) for f in found}

    def weights(ids):
        n, held = Counter(y[k] for k in ids), Counter((f, y[k]) for k in ids for f in set().union(*map(features, texts[k].split())))
        ratio = {f: math.log((held[f, 1] + 0.1) / (n[1] + 1)) - math.log((held[f, 0] + 1) / (n[0] + 1)) for f, label in held if label == 1}
        return {f: r for f, r in ratio.items() if held[f, 1] >= 3 and r >= math.log(4)}

    def inputs(text, lexicon):
        words = (text or "").split()
        hits = [w for w in (max((lexicon.get(f, 0.0) for f in features(x)), default=0.0) for x in words) if w]
        total = sum(hits)
        return [1.0, math.log1p(len(hits)), max(hits, default=0.0), math.log1p(max(total, 0)), total / math.sqrt(max(1, len(words))), math.log1p(len(words))]

    sides = [weights([k for k in sample if half[k] == h]) for h in (0, 1)]
    x = np.array([inputs(texts[k], sides[1 - half[k]]) for k in sample])
    labels_ = np.array([y[k] for k in sample], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, beta = (x - mean) / scale, np.zeros(6)
    step = 1 / (0.25 * np.linalg.eigvalsh(z.T @ z)[-1] + 0.1)
    for _ in range(60_000):
        beta += step * (z.T @ (labels_ - 1 / (1 + np.exp(-z @ beta))) - 0.1 * beta)
    whole = weights(sample)
    assert whole.keys() == model.weights.keys() and whole
    for k, t in [*rows, (999, None), (998, "")]:
        want = 1 / (1 + math.exp(-float(((np.array(inputs(t, whole)) - mean) / scale) @ beta)))
        assert abs(got[k] - want) < 1e-4, (k, got[k], want)
