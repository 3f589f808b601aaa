"""Byte-level BPE by cached words: ids exactly as the tokenizers library gives them for whole texts.

A text's pre-tokens are fixed points of the pre-tokenizer, so each distinct one is encoded by the
library once and its ids are joined from a bounded cache. Texts for which that is not certain (an
added token inside, characters outside a plain range, another kind of tokenizer) go whole through
the library.
"""

from __future__ import annotations

import bisect
import json
import re
import sys
from array import array
from itertools import accumulate, chain

import numpy as np

from siteglass.llm.word_table import PIECE, WordTable, pieces

#: Characters whose classes (letter, number, space, other) agree in Python's re and the library.
_DOUBTFUL = re.compile("[^\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧]")
#: The byte-level pre-tokenizer's pattern for such texts.
_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Contractions that a prefix cuts into two pre-tokens: tokens of their prefixes.
_CUT_CONTRACTIONS = {"'re": 2, "'ve": 2, "'ll": 2}
_LONG_WORD = 96
#: White space as the pre-tokenizer takes it.
_WHITE_RUN = re.compile(r"[^\S\x1c-\x1f]+")


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Vocabulary:
    """What both encoders need of a tokenizers .json file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.added = {x["content"]: x["id"] for x in added}
        self.plain_added = all(not (x["single_word"] or x["lstrip"] or x["rstrip"]) for x in added)
        self.find_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.size = max(self.library.get_vocab_size(), 1 + max(self.added.values(), default=0))
        self.width = 2 if self.size <= 1 << 16 else 4

    def pack(self, ids: list[int]) -> bytes:
        out = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def _plain(self, text: str) -> bool:
        return self.byte_level and len(text) < PIECE and not _DOUBTFUL.search(text) and not (self.find_added and self.find_added.search(text))

    def pretokens(self, text: str) -> list[str]:
        """Of a text without added tokens."""
        if not _DOUBTFUL.search(text):
            return _PRETOKENS.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]


_LETTER, _NUMBER, _OTHER, _SPACE, _WHITE, _END = range(6)


def _classes() -> np.ndarray:
    """The pre-tokenizer's class of each character below U+2028 that is not doubtful; of U+0000, which
    stands between texts, _END."""
    out = np.full(0x2028, _OTHER, np.int8)
    for c in map(chr, [*range(1, 0x250)]):
        out[ord(c)] = _LETTER if c.isalpha() else _NUMBER if c.isdigit() else _SPACE if c == " " else _WHITE if c.isspace() else _OTHER
    out[0] = _END
    return out


def cut_pretokens(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; points are characters, each text ended by 0."""
    c = _CLASSES[points]
    white = (c == _SPACE) | (c == _WHITE)
    kind = np.where(white, _WHITE, c)
    starts = np.empty(len(c), bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= c == _END
    # the last white character before a word is apart from those before it; a space joins the word
    last = np.flatnonzero(white[:-1] & (kind[1:] < _SPACE))
    starts[last] = True
    starts[last[c[last] == _SPACE] + 1] = False
    quote = np.flatnonzero((points[:-2] == 39) & starts[:-2] & (c[1:-1] == _LETTER))
    if len(quote):
        one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for chosen, n in ((short, 2), (long & ~short, 3)):
            q = quote[chosen]
            starts[q + 1] = False
            q = q[q + n < len(c)]
            starts[q + n] |= c[q + n] == _LETTER
    return np.flatnonzero(starts)


_CLASSES = _classes()


class WordEncoder(Vocabulary):
    """encode_many(texts): the ids of each as little-endian bytes of `width` each."""

    def __init__(self, path: str, most_words: int = 1_500_000) -> None:
        super().__init__(path)
        self.spaced = np.zeros(self.size, bool)  # ids whose token begins with the space's stand-in
        space = _byte_alphabet()[32]
        self.spaced[[i for t, i in self.library.get_vocab().items() if t[0] == space]] = True
        self.table = WordTable(most_words, cut_pretokens)
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.ids = np.zeros(1 << 20, f"<u{self.width}")
        self.first = np.zeros(1 << 16, np.int64)  # where a word's ids start; its successor's start is their end

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Words that start with a space are cut from each other again, so they go to the library as one
        text; only a word's first token begins with a space."""
        out: list[list[int]] = [[]] * len(words)
        spaced = [k for k, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        if spaced:
            found = self.library.encode_batch_fast(["".join([words[k] for k in spaced])], add_special_tokens=False)[0]
            ids = found.ids
            cuts = [*np.flatnonzero(self.spaced[ids])[1:].tolist(), len(ids)]
            if len(cuts) == len(spaced):
                a = 0
                for k, b in zip(spaced, cuts, strict=True):
                    out[k] = ids[a:b]
                    a = b
        rest = [k for k, x in enumerate(out) if not x]
        for k, e in zip(rest, self.library.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        found = self._encode_words(words)
        n, flat = self.table.n, np.fromiter(chain.from_iterable(found), self.ids.dtype)
        low = n - len(words)
        ends = self.first[low] + np.cumsum([len(x) for x in found])
        while n + 1 > len(self.first):
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.first[low + 1 : n + 1] = ends
        self.ids[self.first[low] : ends[-1]] = flat

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        out = [b""] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if t and self._plain(t):
                plain.append(k)
            elif t:
                out[k] = self.pack(self.library.encode(t, add_special_tokens=False).ids)
        for group in pieces([texts[k] for k in plain]):
            joined = "\0".join([texts[plain[g]] for g in group]) + "\0"
            if self.table.n > self.table.most_words:
                self.clear()
            starts, ends, numbers = self.table.find(joined)
            new = self.table.add(numbers)
            self._learn([joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            ended = numbers == -2
            numbers[ended] = 0
            low = self.first[numbers]
            n = self.first[numbers + 1] - low
            n[ended] = 0
            stop = np.cumsum(n)
            ids = self.ids[np.arange(stop[-1]) + np.repeat(low - (stop - n), n)]
            at = 0
            for g, b in zip(group, stop[ended].tolist(), strict=True):
                out[plain[g]] = ids[at:b].tobytes()
                at = b
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


class PrefixCounter(Vocabulary):
    """Exact token counts of all prefixes of a text, by dynamic programming over last tokens.

    The encoding of a prefix of a pre-token ends in exactly one token t for which the shorter
    prefix's last token and t stay apart when both are encoded together. So the table holds, for
    each prefix, its last token and one more than the count of the prefix before that token.
    """

    def __init__(self, path: str, most_words: int = 1_500_000, most_pairs: int = 250_000) -> None:
        super().__init__(path)
        if not (self.byte_level and self.plain_added):
            raise ValueError("prefix counts need a byte-level BPE whose added tokens match plainly")
        self.most_pairs = most_pairs
        self.words = WordTable(most_words, cut_pretokens)
        self.known = np.zeros(1 << 16, np.int64)
        alphabet = _byte_alphabet()
        self.letters = {b: alphabet[b] for b in range(256)}
        model = self.library.model
        self.ids = {t: i for t, i in self.library.get_vocab(with_added_tokens=False).items()}
        self.longest = max(map(len, self.ids))
        # lengths of the tokens that end in a letter, longest first: few, whatever the longest token is
        lengths: dict[str, set[int]] = {}
        for t in self.ids:
            lengths.setdefault(t[-1], set()).add(len(t))
        self.lengths = {c: sorted(x, reverse=True) for c, x in lengths.items()}
        # no token covers more characters than this
        self.widest = max([self.longest, *map(len, self.added)])
        self.tokenize = model.tokenize
        self.whole = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.totals: dict[str, int] = {}

    def _is_whole(self, token: str) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = len(self.tokenize(token)) == 1
        return known

    def _stay_apart(self, pair: tuple[str, str]) -> bool:
        if len(self.apart) > self.most_pairs:
            self.apart.clear()
        found = [t.value for t in self.tokenize(pair[0] + pair[1])]
        known = self.apart[pair] = found == [*pair]
        return known

    def table(self, word: str) -> list[int]:
        """Token counts of word[:0], word[:1], ... word, of one pre-token."""
        plain = word.isascii()
        letters = self.letters
        s = "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])
        n, ids, apart, lengths = len(s), self.ids, self.apart, self.lengths
        counts, last = [0] * (n + 1), [""] * (n + 1)
        for end in range(1, n + 1):
            for length in lengths.get(s[end - 1], ()):
                start = end - length
                if start < 0:
                    continue
                token = s[start:end]
                if token in ids and (start == 0 or last[start]):
                    if start == 0:
                        if not self._is_whole(token):
                            continue
                    else:
                        pair = (last[start], token)
                        if not (apart[pair] if pair in apart else self._stay_apart(pair)):
                            continue
                    counts[end], last[end] = counts[start] + 1, token
                    break
        if word in _CUT_CONTRACTIONS:
            counts[2] = _CUT_CONTRACTIONS[word]
        if plain:
            return counts
        ends = list(accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word))
        return [0, *(counts[e] for e in ends)]

    def total(self, word: str) -> int:
        """The tokens of a whole pre-token; of a very long one the library's count, in time nearly in
        proportion to its length and without a table."""
        if (known := self.totals.get(word)) is None:
            if len(word) > _LONG_WORD:
                return len(self.library.encode(word, add_special_tokens=False).ids)
            known = self.table(word)[-1]
            if len(self.totals) > 100_000:
                self.totals.clear()
            self.totals[word] = known
        return known

    def parts(self, text: str) -> list[str]:
        """Pre-tokens and added tokens of a whole text, in order."""
        if not (self.find_added and self.find_added.search(text)):
            return self.pretokens(text)
        out, at = [], 0
        for m in self.find_added.finditer(text):
            out += [*(self.pretokens(text[at : m.start()]) if m.start() > at else ()), m[0]]
            at = m.end()
        return out + (self.pretokens(text[at:]) if at < len(text) else [])

    def counts_of(self, parts: list[str]) -> list[int]:
        try:
            return list(map(self.totals.__getitem__, parts))
        except KeyError:
            return [1 if w in self.added else self.total(w) for w in parts]

    def count(self, text: str | None) -> int:
        return sum(self.counts_of(self.parts(text))) if text else 0

    def _segment(self, text: str) -> tuple[list[int], int, str]:
        """Token counts of all prefixes of a text without added tokens; the tokens before its last two
        pre-tokens, and these: only they change with what follows. A prefix that ends in white space has
        the whole run of it as one pre-token: one table for each run answers for all of them."""
        out, parts = [0] * (len(text) + 1), self.pretokens(text)
        sums, at, run_end = [0], 0, 0
        for w in parts:
            table, base = self.table(w), sums[-1]
            for k in range(max(1, run_end - at + 1), len(w) + 1):
                if at + k <= run_end:
                    continue
                if found := _WHITE_RUN.match(text, at + k - 1):
                    run_end = found.end()
                    out[at + k : run_end + 1] = [base + table[k - 1] + n for n in self.table(found[0])[1:]]
                else:
                    out[at + k] = base + table[k]
            at += len(w)
            sums.append(base + table[-1])
        return out, sums[max(0, len(parts) - 2)], "".join(parts[-2:])

    def prefixes(self, text: str | None) -> list[int]:
        """Token counts of text[:0], text[:1], ... text."""
        out, at = [0], 0
        for m in self.find_added.finditer(text) if text and self.find_added else ():
            base = out[-1]
            counts, before, tail = self._segment(text[at : m.start()])
            out += [base + n for n in counts[1:]]
            # a cut added token is ordinary text that goes on after the segment
            out += [base + before + len(self.library.encode(tail + m[0][:k], add_special_tokens=False).ids) for k in range(1, len(m[0]))]
            out.append(base + counts[-1] + 1)
            at = m.end()
        base = out[-1]
        return out + [base + n for n in self._segment((text or "")[at:])[0][1:]]

    def fitting(self, text: str | None, limit: int) -> tuple[int, int]:
        return self.fitting_many([text], limit)[0]

    def fitting_many(self, texts: list[str | None], limit: int) -> list[tuple[int, int]]:
        """Of each text its tokens, and the length in characters of its longest prefix of at most
        `limit` tokens; only the pre-tokens around the limit are looked into."""
        out = [(0, 0)] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if t and self._plain(t):
                plain.append(k)
            elif t:
                parts = self.parts(t)
                sums = list(accumulate(self.counts_of(parts)))
                out[k] = self._fit(t, [0, *accumulate(map(len, parts))], sums, limit)
        for group in pieces([texts[k] for k in plain]):
            joined = "\0".join([texts[plain[g]] for g in group]) + "\0"
            if self.words.n > self.words.most_words:
                self.words.clear()
            starts, ends, numbers = self.words.find(joined)
            new = self.words.add(numbers)
            while self.words.n > len(self.known):
                self.known = np.concatenate((self.known, np.zeros_like(self.known)))
            if len(new):
                self.known[self.words.n - len(new) : self.words.n] = [self.total(joined[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            ended = np.flatnonzero(numbers == -2)
            counts = self.known[numbers]
            counts[ended] = 0
            sums = np.cumsum(counts)
            first = base = 0
            for g, e in zip(group, ended.tolist(), strict=True):
                k = plain[g]
                total = int(sums[e]) - base
                if total <= limit:
                    out[k] = (total, len(texts[k]))
                else:
                    out[k] = self._fit(texts[k], starts[first : e + 1] - starts[first], sums[first:e] - base, limit)
                first, base = e + 1, int(sums[e])
        return out

    def _fit(self, text: str, starts, sums, limit: int) -> tuple[int, int]:
        """starts has each part's and the end; sums the tokens up to and with each part. A prefix of more than
        `limit` times the widest token's characters has too many tokens for sure."""
        total = int(sums[-1])
        if total <= limit:
            return total, len(text)
        k = bisect.bisect_right(sums, limit)
        low, high = max(0, k - 2), min(len(sums), k + 3)
        base, start = int(sums[low - 1]) if low else 0, int(starts[low])
        near = self.prefixes(text[start : min(int(starts[high]), start + (limit - base + 1) * self.widest)])
        return total, start + max((i for i, n in enumerate(near) if base + n <= limit), default=0)
