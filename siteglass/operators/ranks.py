"""Simulated rank positions: a seeded, mean-reverting walk for each page and keyword.

A day's step depends on the pair, the day and the position before it, so filling a to b and then b to c
from b's last position gives what filling a to c does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: Fixed values of the walk: how far a day goes back to the pair's home, its noise, how often it jumps and how far.
REVERT, NOISE, JUMP_SHARE, JUMP_LEAST, JUMP_MOST = 0.15, 2.0, 0.02, 5.0, 15.0
#: Fixed values of a pair's home: the best position, the spread by relevance, the jitter.
BEST, SPREAD, JITTER = 3.0, 85.0, 12.0
_ALL = 0xFFFFFFFF


def seed(url: str, term: str) -> int:
    """FNV-1a over the UTF-8 of url, a zero byte and term, unsigned 32 bits."""
    h = FNV_OFFSET
    for b in f"{url}\0{term}".encode():
        h = (h ^ b) * FNV_PRIME & _ALL
    return h


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 of a text, by built-in functions."""
    data = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(F.filter(F.split(F.regexp_replace(data, "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(_ALL))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without overflow of 64."""
    low = a.bitwiseAND(0xFFFF) * b
    high = (F.shiftright(a, 16) * b).bitwiseAND(0xFFFF) * 65536
    return (low + high).bitwiseAND(_ALL)


def mulberry32(n: Column) -> Column:
    """The first number in [0, 1) of the generator with this seed."""
    s = (n.cast("long") + 0x6D2B79F5).bitwiseAND(_ALL)
    t = _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1).cast("long")))
    u = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(_ALL))
    return u.bitwiseXOR(F.shiftright(u, 14)) / float(1 << 32)


def draws(n: int) -> Iterator[float]:
    """The numbers in [0, 1) of the same generator, one after the other."""
    state = n & _ALL
    while True:
        state = (state + 0x6D2B79F5) & _ALL
        t = (state ^ state >> 15) * (state | 1) & _ALL
        t ^= (t + (t ^ t >> 7) * (t | 61)) & _ALL
        yield (t ^ t >> 14) / 2**32


def clamped(position: float) -> int:
    """Rounded half up, between 1 and 100."""
    return int(min(100, max(1, (position + 0.5) // 1)))


def home(relevance: float, n: int) -> int:
    """Where a pair stays around: near the top if it is relevant."""
    return clamped(BEST + (1 - relevance) ** 1.5 * SPREAD + next(draws(n)) * JITTER)


def walk(url: str, term: str, relevance: float, first_day: int, days: int, last: int | None = None) -> list[int]:
    """Positions of `days` days from first_day on (days since 1970), going on from `last` or from home."""
    n = seed(url, term)
    base = home(relevance, n)
    at, out = base if last is None else last, []
    for day in range(first_day, first_day + days):
        random = draws(n ^ day)
        step = (2 * next(random) - 1) * NOISE
        if next(random) < JUMP_SHARE:
            sign = -1 if next(random) < 0.5 else 1
            step += sign * (JUMP_LEAST + next(random) * (JUMP_MOST - JUMP_LEAST))
        at = clamped(at + REVERT * (base - at) + step)
        out.append(at)
    return out


def simulate(pairs: DataFrame) -> DataFrame:
    """From (page_id, url, term, relevance, first_day, days, last) the rows page_id, term, day, position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.page_id, r.term, r.first_day + k, p) for r in b.itertuples() for k, p in enumerate(walk(r.url, r.term, r.relevance, r.first_day, r.days, None if pd.isna(r.last) else int(r.last)))]
            yield pd.DataFrame(rows, columns=["page_id", "term", "day", "position"])

    from siteglass.sources.shipping import ship

    ship(pairs.sparkSession)
    return pairs.mapInPandas(run, "page_id long, term string, day long, position long")
