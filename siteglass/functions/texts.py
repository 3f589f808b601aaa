"""Text functions on columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates the parts of a title.
TITLE_SEPARATORS = " [|–—·•-] "


def collapse(text: Column) -> Column:
    """White space runs, no-break spaces too, as one space."""
    return F.trim(F.regexp_replace(text, "[\\s\\u00a0]+", " "))


def words(text: Column) -> Column:
    """Words with a letter or digit in them."""
    return F.filter(F.split(collapse(text), " "), lambda w: w.rlike("[\\p{L}\\p{N}]"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def is_weak_token(token: Column) -> Column:
    return (F.length(token) < 2) | token.rlike("^[0-9]+$")


def title_segments(title: Column) -> Column:
    return F.filter(F.transform(F.split(title, TITLE_SEPARATORS), lambda s: F.trim(s)), lambda s: s != "")


def ngrams(tokens: Column, most: int) -> Column:
    """All runs of 1 to `most` tokens, shorter ones first."""

    def of(n: int) -> Column:
        return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(1, most + 1)])


def shingles(tokens: Column, n: int = 5) -> Column:
    return F.when(F.size(tokens) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both))


#: What stands for one plain character: the full-width forms, raised and lowered digits, odd spaces; and for several.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉\u3000\u00a0\u2009\u202f"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "™": "TM", "№": "No", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "ª": "a", "º": "o"}
#: Marks that join the letter before them: grave, acute, circumflex, tilde, diaeresis, ring, cedilla, caron, macron.
_MARKS = "\u0300\u0301\u0302\u0303\u0308\u030a\u0327\u030c\u0304"


def _composed() -> list[tuple[str, str]]:
    """Each pair of a Latin letter and a mark that is one character, by Unicode's own rule."""
    letters = [chr(c + k) for c in (65, 97) for k in range(26)]
    pairs = ((a + mark, unicodedata.normalize("NFC", a + mark)) for a in letters for mark in _MARKS)
    return [(a, b) for a, b in pairs if len(b) == 1]


def compatible(text: Column) -> Column:
    """The compatibility form of what pages write: full-width letters, ligatures, raised digits, and letters with
    marks apart, as plain characters. Texts without any are left alone."""
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "01234567890123456789    "
    wide = F.translate(text, _WIDE + _RAISED, plain)
    for a, b in _LIGATURES.items():
        wide = F.replace(wide, F.lit(a), F.lit(b))
    one = F.when(text.rlike(f"[{_WIDE[0]}-{_WIDE[-1]}{_RAISED}{''.join(_LIGATURES)}]"), wide).otherwise(text)
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _composed()))
    return F.when(text.rlike(f"[{_MARKS}]"), F.aggregate(pairs, one, lambda t, x: F.replace(t, x["a"], x["b"]))).otherwise(one)


def normalised(text: Column, whole: bool = False) -> Column:
    """Lower case; elisions and contractions apart; everything but letters and digits one space. whole takes the
    compatibility form first, which plain text is in already."""
    t = F.lower(compatible(text) if whole else text)
    t = F.regexp_replace(t, "\\b([ldjtmnsc]|qu)['’]", " ")
    t = F.regexp_replace(t, "['’](s|t|re|ve|ll|d|m)\\b", "")
    t = F.regexp_replace(t, "['’]", "")
    return F.trim(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", " "))


def iso_language(lang: Column) -> Column:
    return F.lower(F.get(F.split(lang, "[-_]"), 0))


def clip(text: Column, width: int) -> Column:
    """The first `width` units of UTF-16, as column widths count them; a character that they would cut goes."""
    units = F.encode(text, "UTF-16BE")
    last = F.hex(F.substring(units, 2 * width - 1, 1))
    cut = F.when(last.between("D8", "DB"), F.substring(units, 1, 2 * width - 2)).otherwise(F.substring(units, 1, 2 * width))
    return F.when(F.octet_length(units) <= 2 * width, text).otherwise(F.decode(cut, "UTF-16BE"))


#: Verbs that end a clause and no subject.
CLAUSE_VERBS = ("is", "are", "was", "were", "has", "have", "had", "can", "will", "do", "does", "did", "get", "make", "need", "use", "want", "work")


def clause_shaped(term: Column, verbs: tuple[str, ...] = CLAUSE_VERBS) -> Column:
    """A term of several words that ends in a verb: a piece of a clause, not a subject."""
    tokens = F.split(term, " ")
    return (F.size(tokens) >= 2) & F.element_at(tokens, -1).isin(*verbs)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def letters_by_script(text: Column) -> Column:
    """Letters of each script that a title may be in."""
    return F.struct(*[F.regexp_count(text, F.lit(f"\\p{{Is{s}}}")).alias(s.lower()) for s in ("Latin", "Cyrillic", "Greek", "Han", "Arabic", "Hebrew")])


def is_clean(values: Column) -> Column:
    """An array without nulls, empty texts and repeats; null for no array."""
    bad = F.exists(values, lambda x: x.isNull() | (x == ""))
    return F.when(values.isNotNull(), ~F.coalesce(bad, F.lit(False)) & (F.size(F.array_distinct(values)) == F.size(values)))


#: Fixed values, as patterns: a word that the page cut off for display, one that brackets cut in two, and where phrases end.
_TRUNCATED, _SPLIT_WORD = "[\\p{L}\\p{N}]+(?:…|\\.\\.\\.)", "([\\p{L}\\p{N}]+)[()\\[\\]{}]+[\\p{L}\\p{N}]+"
_BREAK = "[.,!?;:…()\\[\\]{}\"“”«»|/\\\\]+(?:\\s|$)|[\\r\\n]+|\\s[-–—]\\s"


def tokenize(text: Column) -> Column:
    """Runs of tokens, as an array of arrays of struct(token, glued): a run ends where a sentence or clause
    does; glued says that a token was written as one word with the one before it. Runs of weak tokens alone
    are left out."""
    clean = F.regexp_replace(F.regexp_replace(compatible(text), _TRUNCATED, " "), _SPLIT_WORD, "$1 ")

    def tokens(word: Column) -> Column:
        parts = F.filter(F.split(normalised(word), " "), lambda t: t != "")
        joined = word.rlike("[\\p{L}\\p{N}][-/][\\p{L}\\p{N}]")
        return F.transform(parts, lambda t, i: F.struct(t.alias("token"), (joined & (i > 0)).alias("glued")))

    runs = F.transform(F.split(clean, _BREAK), lambda s: F.flatten(F.transform(F.filter(F.split(s, "\\s+"), lambda w: w != ""), tokens)))
    return F.filter(runs, lambda r: F.exists(r, lambda t: ~is_weak_token(t["token"])))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of value, which is worked out once though then names it often."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lines_normalised(lines: Column) -> Column:
    """`normalised` of each line of a text, but for spaces at the ends of lines: no rule reaches over white space."""

    def apart(t: Column) -> Column:
        marks = F.regexp_replace(F.regexp_replace(t, "\\b([ldjtmnsc]|qu)['’]", " "), "['’](s|t|re|ve|ll|d|m)\\b", "")
        return F.when(F.contains(t, F.lit("'")) | F.contains(t, F.lit("’")), F.regexp_replace(marks, "['’]", "")).otherwise(t)

    return F.regexp_replace(_once(F.lower(lines), apart), "[^\\p{L}\\p{N}\\n]+", " ")


def token_lines(text: Column) -> Column:
    """The runs of tokenize as lines, runs of weak tokens too: tokens apart by a space, a glued one by a hyphen. Lines may be
    empty and have spaces at their ends."""
    joined = "[\\p{L}\\p{N}][-/][\\p{L}\\p{N}]"

    def word(w: Column) -> Column:
        return F.when(w.rlike(joined), F.translate(normalised(w), " ", "-")).otherwise(normalised(w))

    def run(s: Column) -> Column:
        return F.array_join(F.filter(F.transform(F.split(s, "\\s+"), word), lambda w: w != ""), " ")

    def lines(t: Column) -> Column:
        glued = (F.contains(t, F.lit("-")) | F.contains(t, F.lit("/"))) & t.rlike(joined)
        return F.when(glued, F.array_join(F.transform(F.split(t, _BREAK), run), "\n")).otherwise(lines_normalised(F.regexp_replace(t, _BREAK, "\n")))

    whole = _once(compatible(text), lambda t: F.when(F.contains(t, F.lit("…")) | F.contains(t, F.lit("...")), F.regexp_replace(t, _TRUNCATED, " ")).otherwise(t))
    return _once(_once(whole, lambda t: F.when(t.rlike("[()\\[\\]{}]"), F.regexp_replace(t, _SPLIT_WORD, "$1 ")).otherwise(t)), lines)


def strip_title_chrome(title: Column, site: Column, site_name: Column, chrome: Column) -> Column:
    """The title without the parts at its end that name the brand or that most of the run repeats; the first
    part always stays."""
    brands = F.filter(F.array(normalised(F.substring_index(site, ".", 1)), normalised(F.coalesce(site_name, F.lit("")))), lambda b: b != "")
    parts = title_segments(title)

    def is_chrome(part: Column) -> Column:
        tail = normalised(part)
        return F.exists(brands, lambda b: F.contains(F.concat(F.lit(" "), tail, F.lit(" ")), F.concat(F.lit(" "), b, F.lit(" ")))) | F.coalesce(F.array_contains(chrome, tail), F.lit(False))

    last = F.array_max(F.transform(parts, lambda x, i: F.when((i == 0) | ~is_chrome(x), i + 1).otherwise(0)))
    return F.array_join(F.slice(parts, F.lit(1), F.coalesce(last, F.lit(0))), " - ")


def slug(stem: Column) -> Column:
    """The words of a URL's last part."""
    return F.regexp_replace(stem, "[-_]", " ")
