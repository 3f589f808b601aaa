"""Benchmark decontamination by template canonicalisation, with built-in functions only.

A text is cut into words, numbers and signs. Its template replaces numbers, units after a number and
names (capitalised words after a word of the same sentence) by typed placeholders; a second template keeps the names
as lower-case words, so that a copy in another case is found too. Windows of WINDOW template tokens,
hashed, are joined with those of the benchmark's items. What a window's placeholders stand for in the
document and in the item are its slots: at one alignment, each value of the item must stand for one
value in the document, or the windows of that alignment whose slots differ from the item's do not count;
windows equal to the item's, slots and all, always do. So a re-parameterised question (other numbers and
names throughout) is caught, a copy edited in places too, and text that only shares a template's shape is not.

A text leaks an item if consistent windows cover at least `share` of the item's windows. An item of fewer
than WINDOW tokens is one window of all its tokens. Windows of fewer than LEAST_LITERALS words besides
placeholders say too little as templates and are not used, but where an item has no others: then they
count where they are equal to the item's, slots and all. Items of fewer than LEAST_LITERALS tokens are not
looked for, as any text may hold them; `unchecked` lists them. Two values of an item may stand for one value
in the document (3 apples and 5 pears asked as 4 apples and 4 pears), one never for two.

All documents are scanned once by hashes alone; only texts with a hit are cut again with their slots.
The verdict depends on the text alone, so equal texts are judged once, by two 64-bit hashes of the
text, whatever their ids. The benchmark's windows are broadcast if their counted number is small and
shuffled otherwise.

Null and empty texts and items have no windows. Repeated rows get equal results; null ids are kept as
such. An empty table on either side gives no leaks. Other columns of documents pass through `clean`
and are not read otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import joined_small, stored

WINDOW, LEAST_LITERALS = 8, 5
#: Texts with a hit that one task cuts into windows.
TEXTS_A_TASK = 500
#: What may follow a number as its unit.
UNITS = (
    "%", "$", "€", "£", "°", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons",
    "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week",
    "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "meter", "meters", "metre", "metres",
)
#: Placeholders inside a template: characters that no text is expected to hold; those of a text are blanked.
_NAME, _NUMBER, _UNIT = "\x01", "\x02", "\x03"
_NUMERAL = "[0-9]+(?:[.,][0-9]+)*"
_NAMES = "\\p{Lu}(?<=[\\p{L}\\p{M}\\p{N},;] {1,3}\\p{Lu})\\p{Ll}+(?![\\p{L}\\p{M}])"
_MEASURES = _NUMERAL + " {0,3}(?i:" + "|".join(re.escape(u) for u in sorted(UNITS, key=lambda u: (-len(u), u))) + ")(?![\\p{L}\\p{M}])"
_TOKENS = "[\\p{L}\\p{M}]+|[\\x01-\\x03%$€£°]"
_RAW_TOKENS = "[\\p{L}\\p{M}]+|" + _NUMERAL + "|[%$€£°]"


def text_key(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("second"), t).alias("k2")]


def _template(text: Column) -> Column:
    """The tokens of a text, lower-cased, numbers and units replaced."""
    measured = F.regexp_replace(text, _MEASURES, f" {_NUMBER} {_UNIT} ")
    return F.regexp_extract_all(F.lower(F.regexp_replace(measured, _NUMERAL, f" {_NUMBER} ")), F.lit(_TOKENS), F.lit(0))


def _templates(df: DataFrame, text: str) -> DataFrame:
    """df with __a, the template, and __b, the one that keeps names, null where there are none."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), _NAME + _NUMBER + _UNIT, "   ")
    out = df.withColumn("__plain", plain).withColumn("__named", F.regexp_replace("__plain", _NAMES, _NAME))
    return out.withColumn("__a", _template(F.col("__named"))).withColumn("__b", F.when(F.contains("__named", F.lit(_NAME)), _template(F.col("__plain"))))


def _hash(column: str, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(column, i + k) for k in range(size)])


def _hashes(column: str, size: int) -> Column:
    """Hashes of all windows of that many tokens; null if there are fewer tokens or no template."""
    return F.when(F.size(column) >= size, F.transform(F.sequence(F.lit(0), F.size(column) - size), lambda i: _hash(column, i, size)))


def _windows(df: DataFrame, sizes: list[int], kept: list[str], literals: bool = False) -> DataFrame:
    """A row for each window of df's templates: kept columns, pos, size, hash, slots (offset, kind and
    value of each placeholder; null if there is none), and literals, the number of words, if asked for."""
    df = df.withColumn("__raw", F.transform(F.regexp_extract_all("__plain", F.lit(_RAW_TOKENS), F.lit(0)), F.lower))
    places = F.filter(
        F.transform("__a", lambda t, i: F.when(t.isin(_NAME, _NUMBER, _UNIT), F.struct(i.alias("at"), t.alias("kind"), F.get("__raw", i).alias("value")))),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("__places", places)

    def window(column: str, size: int):
        def one(i: Column) -> Column:
            inside = F.filter("__places", lambda x: (x["at"] >= i) & (x["at"] < i + size))
            kinds = (_NAME, _NUMBER, _UNIT) if column == "__a" else (_NUMBER, _UNIT)
            slots = F.transform(F.filter(inside, lambda x: x["kind"].isin(*kinds)), lambda x: F.struct((x["at"] - i).alias("offset"), x["kind"].alias("kind"), x["value"].alias("value")))
            fields = [i.alias("pos"), F.lit(size).alias("size"), _hash(column, i, size).alias("hash"), F.when(F.size("__places") > 0, slots).alias("slots")]
            if literals:
                fields.append(F.size(F.filter(F.slice(column, i + 1, size), lambda t: ~t.isin(_NUMBER, _UNIT, _NAME, "%", "$", "€", "£", "°"))).alias("literals"))
            return F.struct(*fields)

        return one

    out = None
    for column in ("__a", "__b"):
        for size in sizes:
            spans = F.when(F.size(column) >= size, F.transform(F.sequence(F.lit(0), F.size(column) - size), window(column, size)))
            part = df.select(*kept, F.explode(spans).alias("w")).select(*kept, "w.*")
            out = part if out is None else out.unionByName(part)
    return out


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, pos, size, hash, slots and verbatim (the slots must be equal) of each usable window, and windows,
    how many positions of the item have one."""
    # stored, so that no filter on sizes is pushed into the templates' expressions
    cut = stored(_templates(benchmark.select(F.col(item).alias("item"), F.col(text).alias("__text")), "__text").withColumn("__n", F.size("__a")), "benchmark-templates")
    short = [r[0] for r in cut.where((F.col("__n") >= LEAST_LITERALS) & (F.col("__n") < WINDOW)).select("__n").distinct().collect()]
    long = _windows(cut.where(F.col("__n") >= WINDOW), [WINDOW], ["item"], True)
    for size in sorted(short):
        long = long.unionByName(_windows(cut.where(F.col("__n") == size), [size], ["item"], True))
    long = stored(long, "benchmark-cut")
    strong = long.where(F.col("literals") >= LEAST_LITERALS)
    # items without a strong window have their others, of the plain template, which must be equal in all slots
    weak = long.where(F.col("literals") < LEAST_LITERALS).join(strong.select("item").distinct(), "item", "left_anti")
    usable = strong.withColumn("verbatim", F.lit(False)).unionByName(weak.withColumn("verbatim", F.lit(True))).dropDuplicates(["item", "pos", "hash"]).drop("literals")
    counted = usable.groupBy("item").agg(F.countDistinct("pos").alias("windows"))
    return usable.join(counted, "item")


def unchecked(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The items (item, tokens) that are not looked for: they have fewer than LEAST_LITERALS tokens."""
    cut = _templates(benchmark.select(F.col(item).alias("item"), F.col(text).alias("__text")), "__text")
    return cut.select("item", F.size("__a").alias("tokens")).where(F.col("tokens") < LEAST_LITERALS)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: float = 0.3, most_broadcast: int = 500_000) -> DataFrame:
    """k1, k2 (see text_key), item, found (distinct consistent windows), windows, and reparameterised
    (a slot differs from the item's) of each text and item that it leaks."""
    wanted = stored(benchmark_windows(benchmark), "benchmark-windows")
    rows = wanted.count()
    sizes = sorted({r["size"] for r in wanted.select("size").distinct().collect()}) or [WINDOW]
    scanned = _templates(docs.select(F.col(text).alias("__text")), "__text")
    all_hashes = F.concat(*[F.coalesce(_hashes(c, s), F.array().cast("array<bigint>")) for c in ("__a", "__b") for s in sizes])
    hashes = scanned.select(*text_key(F.col("__text")), F.explode(all_hashes).alias("hash"))
    hit = joined_small(hashes, wanted.select("hash").distinct(), "hash", "left_semi", rows, most_broadcast).select("k1", "k2").distinct()
    hit = stored(hit, "hit-texts")
    keyed = docs.select(F.col(text).alias("__text"), *text_key(F.col(text)))
    found = hit.count()
    # equal texts once; then dealt by number and not by bytes, as cutting their windows is what takes time
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found // TEXTS_A_TASK))
    again = joined_small(keyed, hit, ["k1", "k2"], "left_semi", found, most_broadcast).dropDuplicates(["k1", "k2"]).repartition(parts, "k1", "k2")
    spans = _windows(_templates(again, "__text"), sizes, ["k1", "k2"])
    items = wanted.select("hash", "size", "item", "windows", "verbatim", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    met = joined_small(spans, items, ["hash", "size"], "inner", rows, most_broadcast)
    none = F.array().cast("array<struct<offset:int,kind:string,value:string>>")
    # equal hashes have equal templates, so their slots are at the same offsets
    slots = F.zip_with(F.coalesce("item_slots", none), F.coalesce("slots", none), lambda o, t: F.struct(o["kind"].alias("kind"), o["value"].alias("ours"), t["value"].alias("theirs")))
    met = stored(met.select("k1", "k2", "item", "windows", "verbatim", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", slots.alias("slots")), "met-windows")
    at = ["k1", "k2", "item", "shift"]
    values = met.where(F.size("slots") > 0).select(*at, F.explode("slots").alias("s")).select(*at, "s.kind", "s.ours", "s.theirs")
    torn = values.groupBy(*at, "kind", "ours").agg(F.min("theirs").alias("low"), F.max("theirs").alias("high")).where("low != high").select(*at).distinct()
    changed = F.exists("slots", lambda s: s["ours"] != s["theirs"])
    met = met.withColumn("changed", changed).where(~F.col("verbatim") | ~F.col("changed"))
    flagged = met.join(torn.withColumn("torn", F.lit(True)), at, "left")
    good = flagged.where(~F.col("changed") | F.col("torn").isNull()).groupBy("k1", "k2", "item", "windows", "item_pos").agg(F.max("changed").alias("changed"))
    found = good.groupBy("k1", "k2", "item", "windows").agg(F.count(F.lit(1)).alias("found"), F.max("changed").alias("reparameterised"))
    return found.where(F.col("found") >= F.col("windows") * share)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, item_id, found, windows and reparameterised of each document and item that it leaks."""
    found = stored(leaks(docs, benchmark, text, **options), "leaks")
    keyed = docs.select(F.col(doc_id), *text_key(F.col(text)))
    joined = joined_small(keyed, found, ["k1", "k2"], "inner", found.count())
    return joined.select(doc_id, F.col("item").alias("item_id"), "found", "windows", "reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that leak nothing."""
    found = stored(leaks(docs, benchmark, text, **options).select("k1", "k2").distinct(), "leaks")
    names = docs.columns
    row = docs.select(F.struct(*names).alias("__row"), *text_key(F.col(text)))
    return joined_small(row, found, ["k1", "k2"], "left_anti", found.count()).select("__row.*")
