"""Token counts, packing and binary records against the library itself."""

import random
import zlib

import numpy as np
import pytest

from siteglass.llm import packing, records, token_counts
from siteglass.llm.bpe import PrefixCounter, WordEncoder
from siteglass.llm.common import vocabulary_path

ODD = [
    None, "", " ", "a   b\n\n c's they're we'll I've <|endoftext|>x<|endoftext|>", "½²x １２ 漢字 é 🙂🙂   z\t\t\tq",
    "\x1c\x1d a", "don'rest x'r 'll'", "_a_b__ 12a3 éÀß ", "'''re", "a\r\n\r\nb", "x" * 3000, "word " * 2000, "same text", "same text",
]


@pytest.fixture(scope="module")
def path():
    return vocabulary_path()


def test_prefixes_and_ids_equal_the_library(path):
    counter, encoder = PrefixCounter(path), WordEncoder(path)
    rng = random.Random(5)
    texts = [t for t in ODD if t and len(t) < 100] + ["".join(rng.choice("ab 'rels\n1é!_ <|endoftext|>") for _ in range(25)) for _ in range(80)]
    for t in texts:
        want = [len(counter.library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert counter.prefixes(t) == want
        for limit in (1, 4):
            assert counter.fitting(t, limit) == (want[-1], len(t) if want[-1] <= limit else max(i for i, n in enumerate(want) if n <= limit))
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == counter.library.encode(t, add_special_tokens=False).ids


def test_worst_cases_take_linear_time(path):
    """A megabyte each of what made prefix counts slow: special strings, white space, one letter, no spaces."""
    import time

    counter = PrefixCounter(path)
    texts = [
        ("some words here and there " * 10 + "<|endoftext|>") * 3800, "word " * 1000 + " \n\t" * 330_000 + " end" * 200, " " * 1_000_000, "a" * 1_000_000,
        "\n" * 1_000_000, "x <|endoftext|>" * 70_000, "<|endoftext|>" * 77_000,
    ]
    for t in texts:
        began = time.process_time()
        n, fit = counter.fitting(t, 1024)
        assert time.process_time() - began < 4
        encode = lambda x: len(counter.library.encode(x, add_special_tokens=False).ids)
        assert n == encode(t) and encode(t[:fit]) <= 1024 < min(encode(t[: fit + k]) for k in range(1, 20))


def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(3, ODD[3], "clash"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_token_counts(spark, path):
    lib = PrefixCounter(path).library
    got = token_counts.token_counts(docs(spark), limit=5).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 5)
    table = token_counts.prefix_counts(docs(spark).where("length(text) < 100")).collect()
    assert all(r.prefix_tokens[len(r.text)] == len(lib.encode(r.text, add_special_tokens=False).ids) for r in table)
    assert token_counts.token_counts(docs(spark).limit(0)).count() == 0


def test_assign_keeps_every_token_once():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.choice([1, 3, 50, 700, 1024, 1025, 5000]) + rng.randrange(40) for _ in range(rng.randrange(60))]
        sequences = packing.assign(lengths, 1024)
        seen = {}
        for s in sequences:
            at = 0
            for i, start, n, offset in s:
                assert offset == at and n > 0
                at += n
                seen.setdefault(i, []).append((start, n))
            assert at <= 1024
        for i, n in enumerate(lengths):
            at = 0
            for start, k in sorted(seen[i]):
                assert start == at
                at += k
            assert at == n
        assert sum(1024 - sum(x[2] for x in s) for s in sequences) < 1024


def test_pack(spark, path):
    lib = PrefixCounter(path).library
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(ODD)}
    rows = packing.pack(docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]), window_tokens=3000).collect()
    sequences = {}
    for r in rows:
        piece = np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.data) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(docs(spark).limit(0)).count() == 0
    assert packing.pack(docs(spark)).where("doc_id is null").count() == 1


def test_records_round_trip(spark, path, tmp_path):
    lib = PrefixCounter(path).library
    df = docs(spark)
    shards = sorted(records.write_records(df, f"file://{tmp_path}/r", shards=3).collect())
    assert sum(r.n_documents for r in shards) == len(ODD) + 2
    back = records.token_records(df, f"file://{tmp_path}/s", shards=3).collect()
    order = sorted(back, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, *sorted([*range(len(ODD)), 3])]
    at = 0
    for r in order:
        text = "no id" if r.doc_id is None else ODD[r.doc_id]
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").data))
        at += len(ids)
    for s in shards:
        for key, ids in records.read_at(s.path, list(range(s.n_documents))[::-1]):
            assert ids == lib.encode(("no id" if key is None else ODD[key]) or "", add_special_tokens=False).ids + [2]
    damaged = tmp_path / "r" / "shard-000000.rec"
    data = bytearray(damaged.read_bytes())
    data[30] ^= 1
    with pytest.raises(ValueError):
        import io

        f = io.BytesIO(bytes(data[8:]))
        while records.unframe(f.read) is not None:
            pass
    assert records.token_records(df.limit(0), f"file://{tmp_path}/t").count() == 0
