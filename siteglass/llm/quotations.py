"""Chat formatting by quotation linking, with built-in functions only.

A message's lines are parsed for nested quote marks (`>`, at any depth, with blanks between). Lines of
level 0 are its own text; neighbouring lines of one deeper level are a quoted passage. An attribution
line right before a quote ("... wrote:") is neither. Passages and own texts are normalised (lower
case, blanks collapsed) and hashed; an own text is filed under the hashes of the whole, of its
paragraphs and of its lines. A passage, or else each of its lines, is joined with the first message of
its own conversation that has that text, and failing that with the first message of all, always one
that comes before the quoting message in (conv_id, turn) order; so links have no cycles.

A message replies to the message of its shallowest linked passage, of several the latest one. Replies
are followed to the top of their thread by pointer doubling, whose rounds grow with the logarithm of
the deepest reply. The result is one row for each message, without quotes, with thread_conv, root_turn,
depth and position, its place (from 0) in the thread's order by (depth, conv_id, turn): each message follows
what it replies to. `formatted` is the message as a chat turn; `transcripts` concatenates them in that order,
in parts of a bounded number of messages. No conversation is gathered in one task, so one that holds a
third of all rows is no hot spot: threads are sorted over all tasks by range, and positions are counted from
where each task's rows begin. Lines that very many messages quote, and messages that very many answer, are
dealt over several tasks.

Null and empty texts are empty messages. Rows equal in conv_id and turn are one place: each row is returned,
with a position of its own, and replies to it are replies to that place. Rows with a null conv_id or turn
cannot be replied to and start their own thread; those of equal nulls share one. A very long text is parsed
whole, in one task. Ties of position go by role and text. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteglass.llm.common import discard, hot_keys, salted_join, scratch_scope, stored

#: Lines of fewer words than this are not looked up by themselves.
LEAST_WORDS = 3
#: Hashes that may be broadcast: 16 MB of them.
MOST_BROADCAST = 2_000_000
MOST_ROUNDS = 64
_MARKS = "^[ \\t]*(?:>[ \\t]*)+"
_WROTE = "(?i)^\\s*(?:on\\s.*\\swrote|am\\s.*\\sschrieb.*|le\\s.*\\sa écrit|el\\s.*\\sescribió)\\s*:\\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\x0b\\f\\r\\n]+", " "))


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with own (the text without quotes), quotes (array of level, passage and place) and
    max_level. Texts without a quote mark at the start of a line are not taken apart."""
    names = [c for c in df.columns if c not in ("own", "quotes", "max_level")]
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.select(*names, t.alias("__t"), t.rlike("(?m)^[ \\t]*>").alias("__q"))
    out = out.withColumn(
        "__lines",
        F.when(
            F.col("__q"),
            F.transform(
                F.split("__t", "\n"),
                lambda x: F.struct(
                    F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("level"),
                    F.regexp_replace(x, _MARKS, "").alias("body"),
                ),
            ),
        ),
    )
    # where a passage begins, and where it ends: the levels change there
    level = lambda i: F.get("__lines", i)["level"]
    out = out.withColumn("__starts", F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1))))
    spans = F.transform(
        "__starts",
        lambda s, k: F.struct(
            s.alias("place"),
            level(s).alias("level"),
            F.slice("__lines", s + 1, F.coalesce(F.get("__starts", k + 1), F.size("__lines")) - s).alias("lines"),
        ),
    )
    out = out.withColumn("__spans", spans)
    quotes = F.transform(F.filter("__spans", lambda x: x["level"] > 0), lambda x: F.struct(x["place"].alias("place"), x["level"].alias("level"), F.array_join(x["lines"]["body"], "\n").alias("passage")))

    def without_attribution(x: Column, k: Column) -> Column:
        quote_follows = F.get("__spans", k + 1).isNotNull()
        last = F.element_at(x["lines"], -1)["body"]
        body = x["lines"]["body"]
        return F.when(quote_follows & last.rlike(_WROTE), F.slice(body, 1, F.size(body) - 1)).otherwise(body)

    pieces = F.transform("__spans", lambda x, k: F.when(x["level"] == 0, F.array_join(without_attribution(x, k), "\n")))
    own = F.trim(F.regexp_replace(F.array_join(F.filter(pieces, lambda p: p.isNotNull()), "\n"), "\\n{3,}", "\n\n"))
    own = F.btrim(own, F.lit(" \n\t\r"))
    out = out.withColumn("own", F.when(F.col("__q"), own).otherwise(F.col("__t")))
    out = out.withColumn("quotes", F.when(F.col("__q"), quotes)).withColumn("max_level", F.when(F.col("__q"), F.array_max(F.col("__lines")["level"])).otherwise(F.lit(0)))
    return out.select(*names, "own", "quotes", "max_level")


def _hash(text: Column) -> Column:
    return F.xxhash64(normalised(text))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.size(F.split(F.trim(x), "\\s+")) >= LEAST_WORDS)


def link(messages: DataFrame) -> DataFrame:
    """From parsed messages (conv_id, turn, own, quotes): conv_id, turn, n_quotes, n_linked, parent_conv,
    parent_turn of each quoting position."""
    here = ["conv_id", "turn"]
    quotes = messages.where(F.col("quotes").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(*here, F.explode("quotes").alias("q")).select(*here, "q.*")
    units = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), _hash(F.col("passage")).alias("hash"))),
        F.transform(_lines(F.col("passage")), lambda x: F.struct(F.lit(1).alias("rank"), _hash(x).alias("hash"))),
    )
    asked = stored(quotes.where(normalised(F.col("passage")) != "").select(*here, "place", "level", F.explode(units).alias("u")).select(*here, "place", "level", "u.rank", "u.hash").distinct(), "quotes")
    filed = F.array_distinct(
        F.concat(
            F.array(_hash(F.col("own"))),
            F.transform(F.split("own", "\\n\\s*\\n"), _hash),
            F.transform(_lines(F.col("own")), _hash),
        )
    )
    wanted = stored(asked.select("hash").distinct(), "wanted")
    origins = messages.where("own != ''").dropna(subset=here).select(*here, F.explode(filed).alias("hash"))
    if wanted.count() <= MOST_BROADCAST:
        origins = origins.join(F.broadcast(wanted), "hash", "left_semi")
    else:
        often = origins.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        origins = salted_join(origins, wanted, ["hash"], hot_keys(often, ["hash"], origins.count()), "turn", "left_semi")
    local = stored(origins.groupBy("hash", "conv_id").agg(F.min("turn").alias("own_turn")), "originals")
    first = local.groupBy("hash").agg(F.min(F.struct("conv_id", "own_turn")).alias("first"))
    hot = hot_keys(asked.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), ["hash"], asked.count())
    by = F.struct("conv_id", "turn", "place")
    met = salted_join(salted_join(asked, local, ["hash", "conv_id"], hot, by, "left"), first, ["hash"], hot, by, "left")
    near = F.col("own_turn") < F.col("turn")
    far = (F.col("first.conv_id") < F.col("conv_id"))
    source = F.when(near, F.struct(F.col("conv_id"), F.col("own_turn").alias("turn"))).when(far, F.struct(F.col("first.conv_id").alias("conv_id"), F.col("first.own_turn").alias("turn")))
    met = met.withColumn("source", source)
    passages = met.groupBy(*here, "place", "level").agg(F.min(F.when(F.col("source").isNotNull(), F.struct("rank", "source"))).alias("s"))
    # of the shallowest linked passages the latest message
    rank = F.when(F.col("s").isNotNull(), F.struct((-F.col("level")).alias("up"), F.col("s.source").alias("source")))
    found = passages.groupBy(*here).agg(F.count(F.lit(1)).alias("n_quotes"), F.count("s").alias("n_linked"), F.max(rank).alias("best"))
    return found.select(*here, "n_quotes", "n_linked", F.col("best.source.conv_id").alias("parent_conv"), F.col("best.source.turn").alias("parent_turn"))


def tops(links: DataFrame) -> DataFrame:
    """Of replying positions (conv_id, turn, parent_conv, parent_turn) the top of their thread and
    their depth, by pointer doubling."""
    at = stored(links.select("conv_id", "turn", F.col("parent_conv").alias("top_conv"), F.col("parent_turn").alias("top_turn"), F.lit(1).cast("long").alias("depth")), "replies")
    for _ in range(MOST_ROUNDS):
        up = at.select(F.col("conv_id").alias("top_conv"), F.col("turn").alias("top_turn"), F.col("top_conv").alias("c"), F.col("top_turn").alias("t"), F.col("depth").alias("more"))
        answers = at.groupBy("top_conv", "top_turn").agg(F.count(F.lit(1)).alias("n"))
        hot = hot_keys(answers, ["top_conv", "top_turn"], at.count())
        moved = salted_join(at, up, ["top_conv", "top_turn"], hot, F.struct("conv_id", "turn"), "left")
        if moved.where("more is not null").isEmpty():
            return at
        new = stored(
            moved.select("conv_id", "turn", F.coalesce("c", "top_conv").alias("top_conv"), F.coalesce("t", "top_turn").alias("top_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
            "replies",
        )
        discard(at)
        at = new
    raise RuntimeError("replies did not settle")


def positioned(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with position, a row's place in its group by `order`, whatever a group's size: rows are sorted over
    all tasks by range, and a group's rows in each task counted."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    sorted_ = stored(sorted_.withColumn("__part", F.shiftright("__id", 33)), "sorted")
    own = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group]
    spans = sorted_.groupBy(*group, "__part").agg(F.min("__id").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(*(F.col(c).alias(f"__{c}") for c in group), F.col("__part").alias("__at"), (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__shift"))
    met = sorted_.join(spans, [*own, F.col("__part") == F.col("__at")])
    return met.select(*rows.columns, (F.col("__id") + F.col("__shift")).alias("position"))


def conversations(df: DataFrame) -> DataFrame:
    """A row for each message of df (conv_id, turn, role, text): conv_id, turn, role, own, max_level,
    n_quotes, n_linked, parent_conv, parent_turn, thread_conv, root_turn, depth, position, formatted."""
    with scratch_scope(df.sparkSession) as keep:
        messages = parsed(df.select("conv_id", "turn", "role", "text"))
        links = stored(link(messages), "links")
        at = tops(links.where("parent_conv is not null"))
        out = messages.select("conv_id", "turn", "role", "own", "max_level").join(links.join(at, ["conv_id", "turn"], "left"), ["conv_id", "turn"], "left")
        out = out.select(
            "conv_id", "turn", "role", "own", F.col("max_level").cast("long").alias("max_level"),
            F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            "parent_conv", "parent_turn",
            F.coalesce("top_conv", "conv_id").alias("thread_conv"), F.coalesce("top_turn", "turn").alias("root_turn"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
            F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "own", F.lit("\n")).alias("formatted"),
        )
        return keep(stored(positioned(out, ["thread_conv", "root_turn"], ["depth", "conv_id", "turn", "role", "own"]), "conversations"))


def transcripts(messages: DataFrame, most: int = 256) -> DataFrame:
    """From the rows of `conversations` the threads as chat texts: thread_conv, root_turn, part, n_messages,
    text; a part holds `most` messages, so a row's size does not grow with the thread's."""
    part = F.floor(F.col("position") / most).cast("long")
    gathered = messages.groupBy("thread_conv", "root_turn", part.alias("part")).agg(F.count(F.lit(1)).alias("n_messages"), F.sort_array(F.collect_list(F.struct("position", "formatted"))).alias("turns"))
    return gathered.select("thread_conv", "root_turn", "part", "n_messages", F.array_join(F.col("turns")["formatted"], "").alias("text"))
