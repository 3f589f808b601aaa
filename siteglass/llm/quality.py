"""Quality rules: a decision list learned from labelled statistics, emitted as Spark conditions.

`statistics` computes a text's numbers with built-in functions only, in one narrow pass. `learn`
fits an ordered list of rules on a bounded sample of labelled rows (at most `most_rows`, those of
smallest hash): sequential covering grows a conjunction of thresholds by information gain on two
thirds of the sample, prunes it on the last third, and keeps it if enough of what it covers there is
bad; the rows it covers go and the next rule begins. `verdict` turns the list into one
F.when(...).when(...) expression that Catalyst compiles.

Null and empty texts have zero words and fail the base test. Repeated rows get equal results. An
empty table, or labels of one class only, learns no rule, and the base test alone decides. Columns
of df named like a result column are replaced; others pass through. Null labels are not used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import words_of

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_same_next")
WINDOW = 5


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the long columns STATISTICS.

    n_words: words (runs of characters other than ASCII white space); word_chars: code points in
    them; n_symbols: characters of #*$%&|<>; n_dup_lines: lines with a word that equal an earlier
    line; n_repeat_words: words in 5-word windows found twice or more; n_same_next: words equal to
    the word before. Windows are compared by 64-bit hashes.
    """
    kept = [F.col(c) for c in df.columns if c not in STATISTICS]
    t = F.coalesce(F.col(text), F.lit(""))
    no_longs = F.array().cast("array<bigint>")
    out = df.select(*kept, t.alias("__t")).withColumn("__w", words_of(F.col("__t")))
    out = out.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0))
    out = out.withColumn(
        "__h",
        F.when(
            F.size("__w") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)])),
        ).otherwise(no_longs),
    )
    # only a text with a repeated window has its windows sorted, with their positions
    out = out.withColumn(
        "__s",
        F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))),
    )

    def paired(x: Column, i: Column) -> Column:
        same = F.coalesce(x["h"] == F.get("__s", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__s", i + 1)["h"], F.lit(False))
        return F.when(same, x["p"])

    out = out.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.array_compact(F.transform("__s", paired)))))
    covered = F.aggregate(
        F.transform("__p", lambda x, i: F.coalesce(F.least(F.get("__p", i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda a, x: a + x,
    )
    lengths = F.length("__t")
    return out.select(
        *kept,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (lengths - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("__w", lambda x, i: x == F.get("__w", i - 1))).cast("long").alias("n_same_next"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What thresholds are learned on: shares, so that long and short texts compare."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / words,
        "repeats": F.col("n_repeat_words") / words,
        "same_next": F.col("n_same_next") / words,
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, float]) -> bool:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] < self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] >= F.lit(self.threshold) if self.at_least else values[self.feature] < F.lit(self.threshold)


Rule = tuple[Literal, ...]
Row = tuple[dict[str, float], bool]


def _best(rows: list[Row], names: list[str]) -> Literal | None:
    """The literal of most information gain over rows; ties go to the earlier feature and lower threshold."""
    p0 = sum(bad for _, bad in rows)
    n0 = len(rows) - p0
    if not p0 or not n0:
        return None
    before, best, found = math.log2(p0 / (p0 + n0)), 1e-9, None
    for name in names:
        by = sorted(((x[name], bad) for x, bad in rows), key=lambda r: r[0])
        p = n = 0
        for k in range(len(by) - 1):
            p, n = p + by[k][1], n + (not by[k][1])
            if by[k][0] == by[k + 1][0]:
                continue
            cut = (by[k][0] + by[k + 1][0]) / 2
            for at_least, p1, n1 in ((True, p0 - p, n0 - n), (False, p, n)):
                if p1 and (gain := p1 * (math.log2(p1 / (p1 + n1)) - before)) > best:
                    best, found = gain, Literal(name, at_least, cut)
    return found


def cover(rows: list[Row], names: list[str], precision: float = 0.9, least: int = 3, most_rules: int = 12, most_literals: int = 4) -> list[Rule]:
    """The decision list for bad rows: rows are (features, bad), in an order that doesn't follow the label."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < most_rules and sum(bad for _, bad in left) >= least:
        grow = [r for k, r in enumerate(left) if k % 3]
        prune = left[::3]
        rule: Rule = ()
        covered = grow
        while len(rule) < most_literals and (new := _best(covered, names)) is not None:
            rule, covered = (*rule, new), [r for r in covered if new.holds(r[0])]

        def worth(r: Rule) -> tuple[float, int]:
            got = [bad for x, bad in prune if all(y.holds(x) for y in r)]
            return ((2 * sum(got) - len(got)) / len(got) if got else -1.0, -len(r))

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = [bad for x, bad in left if all(y.holds(x) for y in rule)] if rule else []
        if sum(hit) < least or sum(hit) < precision * len(hit):
            break
        rules.append(rule)
        left = [r for r in left if not all(y.holds(r[0]) for y in rule)]
    return rules


def learn(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most_rows: int = 20_000) -> list[Rule]:
    """Learns from at most `most_rows` labelled rows, a bound on what the driver holds."""
    key = F.col(doc_id)
    sample = (
        labels.select(key, F.col(label).cast("int").alias("__label"))
        .where(key.isNotNull() & F.col("__label").isNotNull())
        .groupBy(doc_id).agg(F.min("__label").alias("__label"))
        .orderBy(F.xxhash64(key), key).limit(most_rows)
    )
    seen = statistics(df.select(key, F.col(text)).join(F.broadcast(sample), doc_id), text)
    values = features()
    # the base test is a column and not a filter: a filter would be pushed below the statistics and repeat them
    rows = seen.select(F.xxhash64(key).alias("__order"), key, "__label", base_failed().alias("__failed"), *[c.alias(n) for n, c in values.items()]).collect()
    rows = sorted(rows, key=lambda r: (r["__order"], str(r[doc_id])))
    return cover([({n: r[n] for n in values}, r["__label"] == 0) for r in rows if not r["__failed"]], list(values))


def verdict(rules: list[Rule]) -> Column:
    """0 for no rule, else the number of the first rule that holds, as one ordered conditional."""
    values = features()
    out = None
    for k, rule in enumerate(rules, 1):
        condition = F.lit(True)
        for x in rule:
            condition = condition & x.column(values)
        out = F.when(condition, F.lit(k)) if out is None else out.when(condition, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """df with its statistics, base_failed, rule (0: none) and kept."""
    out = statistics(df.drop("base_failed", "rule", "kept"), text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of df that the rules keep, with df's columns only.

    The row number above the statistics stays in the condition, so that the optimizer cannot push the
    filter into their expressions, where they would be worked out again for each element.
    """
    row = df.select(F.struct(*df.columns).alias("__row"), F.col(text).alias("__text"))
    judged = judge(row, rules, "__text").withColumn("__n", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__n") >= 0)).select("__row.*")
