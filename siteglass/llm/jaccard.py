"""N-gram Jaccard join by vertical partitioning, and the components of its links.

A document's set is its distinct word n-grams, as 64-bit hashes.

1. Documents with equal sets (two further 64-bit hashes of the whole set, and its size) are one node,
   the smallest doc_id; so copies never meet in pairs.
2. Sets that stand alone. A set of similarity t or more with another has at most size - ceil(t size)
   n-grams that no other set has. A fixed share of the hash space is enough to prove most sets alone:
   n-grams of that share travel packed, by ranges of hashes, and each set learns how many of them are
   shared. A set with too many of its own is linked with nothing and goes no further. The share and the
   shortened hashes that travel only ever let more sets pass, never fewer.
3. The global n-gram order is by the number of remaining sets that have the n-gram (exact up to
   EXACT_CLASSES, in steps of an eighth of a doubling beyond), rare ones first, and then by hash. N-grams
   of one set alone come first in it and need not be kept. Linked sets share one of the first
   size - ceil(t size) + 1 n-grams of each: its prefix, whose n-grams are its keys.
4. Nodes connected by shared keys are a family, its smallest node their hub. The global order is cut
   into FRAGMENTS fragments of about equal weight, each set into the segments that fall into them.
   Segments of a node and of its hub meet on (hub, fragment), where the partial overlap is counted; the
   sums over fragments are the overlap of the pair. So a family costs a row for each node and
   fragment, and no pair of other members. Hubs of large families are dealt over several tasks.
5. The overlaps say how far a node is from its hub. By the triangle inequality, what is near the hub is
   linked, and one star holds it together. Links of the other nodes are found by a prefix join on the
   differences from the hub, which hold a node's own edits and little else: rarest elements first, cut
   by what overlap the distances ask for, and by what can still follow. The pairs it yields are
   compared by fragments, partial overlaps summed. All tests are exact arithmetic on integers.

Hashes stand for n-grams: a wrong link needs a collision of 64 bits within two compared sets.

Words are runs of other characters than ASCII white space, A-Z lower-cased; fewer words than n make
one n-gram of all. Null, empty and wordless texts have an empty set and are linked with nothing. Rows
of null doc_id have a null component. Repeated rows are returned each; if one doc_id has several
texts, the set of smallest fingerprint takes part in links. Very long texts are read whole, in one task
each. Ties have no part: the smallest doc_id is unique. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteglass.llm.common import discard, hot_keys, joined_small, lean, release, salted_join, scratch_scope, ship, stored
from siteglass.llm.components import components
from siteglass.llm.word_table import hash_spans, mixed, pieces, points_of, word_spans

FRAGMENTS = 8
#: Frequencies up to this are told apart exactly in the global order.
EXACT_CLASSES = 64
#: Ids that may be broadcast: 16 MB of them.
MOST_BROADCAST = 2_000_000
#: Entries of one sorted run in a task, and about as many in a range of hashes.
RUN = 250_000
#: Bits of a hash that travel to find shared n-grams.
CARRIED = 48
#: Rounds in which a key's groups are compared with its smallest node only, before pairs across groups.
ROUNDS = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def ngram_sets(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each text that has words, and its set, ascending."""
    has = [k for k, t in enumerate(texts) if t]
    for group in pieces([texts[k] for k in has]):
        points = points_of("\0".join([texts[has[g]].replace("\0", "\x01") for g in group]) + "\0")
        points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
        starts, ends = word_spans(points)
        words = hash_spans(points, starts, ends, 1)[0]
        bounds = [0, *np.searchsorted(starts, np.flatnonzero(points == 0)).tolist()]
        m = max(0, len(words) - n + 1)
        grams = np.zeros(m, np.uint64)
        for j in range(n):
            grams = grams * _ODD + words[j : j + m]
        grams = mixed(grams)
        for g, a, b in zip(group, bounds, bounds[1:], strict=False):
            if b - a >= n:
                yield has[g], np.unique(grams[a : b - n + 1])
            elif b > a:
                one = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        one = one * _ODD + w
                yield has[g], mixed(np.array([one], np.uint64) ^ _ODD)


def prints(grams: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two hashes of a whole set."""
    return mixed(grams).sum(dtype=np.uint64).view(np.int64), mixed(grams ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)


def share_of(num: int, den: int) -> int:
    """The end of the share of the hash space (of 2**CARRIED) that is looked at to prove sets alone: twice
    what may differ, so that an average set without company has twice as many n-grams there as it may."""
    return min(1 << CARRIED, -(-2 * (den - num) * (1 << CARRIED) // den))


def _carried(grams: np.ndarray, end: int) -> np.ndarray:
    """The n-grams of an ascending set that lie in the share, shortened."""
    short = grams >> np.uint64(64 - CARRIED)
    return short[: np.searchsorted(short, np.uint64(end))] if end < 1 << CARRIED else short


def _signatures(batches: Iterator[pa.RecordBatch], n: int, end: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "size", "few", "one", "two"]
    for batch in batches:
        texts = batch.column(1).to_pylist()
        sizes, few, one, two = (np.zeros(len(texts), np.int64) for _ in range(4))
        for k, grams in ngram_sets(texts, n):
            sizes[k], few[k] = len(grams), len(_carried(grams, end))
            one[k], two[k] = prints(grams)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (sizes, few, one, two))], names=names)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest byte of all first: what sorted or small numbers share compresses."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _whole(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _runs(batches: Iterator[pa.RecordBatch], n: int, end: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """From (node, one, text) sorted runs of entries (2 * shortened n-gram + whether several nodes of the
    run have it, node), cut into ranges. An n-gram goes once for each run; nodes that share one within
    the run are counted there, and the counts sent along under a range below 0."""
    cuts = np.array([end * r // ranges for r in range(1, ranges)], np.uint64)
    grams_, nodes_ = [], []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        g, v = np.concatenate(grams_), np.concatenate(nodes_)
        grams_.clear()
        nodes_.clear()
        held = 0
        order = np.argsort(g, kind="stable")
        g, v = g[order], v[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        times = np.diff(np.append(first, len(g)))
        shared, counts = np.unique(v[np.repeat(times, times) > 1], return_counts=True)
        rows = [(-1 - int(shared[0] % ranges), shared.view(np.uint64), counts)] if len(shared) else []
        g, v = g[first], v[first]
        at = [0, *np.searchsorted(g, cuts).tolist(), len(g)]
        g = (g << np.uint64(1)) | (times > 1).astype(np.uint64)
        rows += [(r, g[a:b], v[a:b].view(np.uint64)) for r, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        for k in range(0, len(rows), 64):
            some = rows[k : k + 64]
            yield _packed([r for r, _, _ in some], [x for _, x, _ in some], [x for _, _, x in some])

    for batch in batches:
        ids, one, texts = (c.to_pylist() for c in batch.columns)
        for k, grams in ngram_sets(texts, n):
            if prints(grams)[0] == one[k]:
                found = np.unique(_carried(grams, end))
                grams_.append(found)
                nodes_.append(np.full(len(found), ids[k], np.int64))
                held += len(found)
        if held >= RUN:
            yield from flush()
    if held:
        yield from flush()


class _Sums:
    """Counts by node, added up in sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting, self.distinct = 0, 0

    def add(self, nodes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((nodes.view(np.int64), counts.view(np.int64)))
        self.waiting += len(nodes)
        if self.waiting > 2 * max(RUN, self.distinct):
            self.parts = [self.take()]
            self.waiting = self.distinct = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        own, back = np.unique(np.concatenate([none, *(a for a, _ in self.parts)]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([none, *(b for _, b in self.parts)]), minlength=len(own)).astype(np.int64)
        self.parts, self.waiting, self.distinct = [], 0, 0
        return own, total


def _packed(numbers: list[int], a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([_planes(x) for x in a], pa.binary()), pa.array([_planes(x) for x in b], pa.binary())], names=["range", "a", "b"])


def _shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """From runs sorted by range: how many n-grams each node shares with others, added up over the task's ranges
    as far as RUN nodes go, packed by the node's part (range, nodes, counts)."""
    at, grams_, nodes_ = None, [], []
    sums = _Sums()

    def sent() -> Iterator[pa.RecordBatch]:
        own, total = sums.take()
        part = (mixed(own.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        own, total = own[order], total[order]
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        full = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        for k in range(0, len(full), 64):
            some = full[k : k + 64]
            yield _packed([r for r, _, _ in some], [own[a:b] for _, a, b in some], [total[a:b] for _, a, b in some])

    def flush() -> None:
        if not grams_:
            return
        g, v = np.concatenate(grams_), np.concatenate(nodes_)
        grams_.clear()
        nodes_.clear()
        order = np.argsort(g, kind="stable")
        g, v = g[order], v[order]
        key = g >> np.uint64(1)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(first, len(key)))
        sums.add(*np.unique(v[(np.repeat(times, times) > 1) & (g & np.uint64(1) == 0)], return_counts=True))

    for batch in batches:
        for r, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r < 0:
                sums.add(_whole(a), _whole(b))
                continue
            if r != at:
                flush()
                at = r
                if sums.distinct > RUN:
                    yield from sent()
            grams_.append(_whole(a))
            nodes_.append(_whole(b))
    flush()
    yield from sent()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed counts of the task's nodes: (node, n), a row for each node."""
    sums = _Sums()
    for batch in batches:
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            sums.add(_whole(a), _whole(b))
    own, total = sums.take()
    for k in range(0, len(own), RUN):
        yield pa.RecordBatch.from_arrays([pa.array(own[k : k + RUN]), pa.array(total[k : k + RUN])], names=["node", "n"])


def company(docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int, known: int, few: int) -> DataFrame:
    """Those of nodes (node, one, size, few) that aren't proven alone; known and few: how many nodes there
    are, and n-grams of theirs in the share."""
    end = share_of(num, den)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(partitions, few // RUN + 1)
    texts = joined_small(docs.withColumnRenamed("doc_id", "node"), nodes.select("node", "one"), "node", "inner", known, MOST_BROADCAST).select("node", "one", "text")
    runs = texts.mapInArrow(lean(lambda batches: _runs(batches, n, end, ranges)), "range int, a binary, b binary")
    dealt = runs.repartition(partitions, "range").sortWithinPartitions("range")
    found = dealt.mapInArrow(lean(lambda batches: _shared(batches, partitions)), "range int, a binary, b binary")
    shared = found.repartition(partitions, "range").mapInArrow(lean(_added), "node long, n long")
    own = F.col("few") - F.coalesce("n", F.lit(0))
    return nodes.join(shared, "node", "left").where(own <= F.col("size") - F.expr(f"(size * {num} + {den - 1}) div {den}")).select("node", "one", "size")


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """From (node, one, text) the node's set, if the text has the set of that fingerprint."""
    for batch in batches:
        nodes, one, texts = (c.to_pylist() for c in batch.columns)
        found = [(nodes[k], grams) for k, grams in ngram_sets(texts, n) if prints(grams)[0] == one[k]]
        if found:
            ends = np.concatenate(([0], np.cumsum([len(g) for _, g in found]))).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([g for _, g in found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.int64()), grams], names=["node", "grams"])


def ordered_sets(docs: DataFrame, alive: DataFrame, n: int, rows: int, grams: int, repeats: bool) -> DataFrame:
    """Of alive (node, one, size), `rows` of them with `grams` n-grams: (node, size, grams), the n-grams that
    several of them have as (class, gram) in the global order."""
    texts = joined_small(docs.withColumnRenamed("doc_id", "node"), alive.select("node", "one"), "node", "inner", rows, MOST_BROADCAST).select("node", "one", "text")
    sets = texts.mapInArrow(lean(lambda batches: _sets(batches, n)), "node long, grams array<long>")
    sets = stored(sets.dropDuplicates(["node"]) if repeats else sets, "sets")
    elements = sets.select("node", F.explode("grams").alias("gram"))
    often = stored(elements.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    class_ = F.when(F.col("n") <= EXACT_CLASSES, F.col("n")).otherwise(EXACT_CLASSES + F.floor(8 * F.log2(F.col("n") / EXACT_CLASSES))).cast("int")
    placed = salted_join(elements, often.select("gram", class_.alias("class")), ["gram"], hot_keys(often, ["gram"], grams), "node")
    out = placed.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("class", "gram"))).alias("grams"))
    out = stored(out.join(alive.select("node", "size"), "node").select("node", "size", "grams"), "ordered")
    discard(sets, often)
    return out


def pivots(ordered: DataFrame) -> list[tuple[int, int]]:
    """FRAGMENTS - 1 places (class, gram) that cut the global order into parts of about equal weight, from
    the n-grams counted by class: a few hundred rows, whatever the input."""
    rows = sorted(tuple(r) for r in ordered.select(F.explode("grams.class").alias("class")).groupBy("class").count().collect())
    total, before, out = sum(n for _, n in rows), 0, []
    for c, n in rows:
        while len(out) < FRAGMENTS - 1 and before + n >= (want := total * (len(out) + 1) // FRAGMENTS):
            out.append((c, min((1 << 63) - 1, (want - before) * (1 << 64) // n - (1 << 63))))
        before += n
    return out


def families(ordered: DataFrame, num: int, den: int, grams: int) -> DataFrame:
    """(node, hub) of nodes connected by shared keys; hub is the smallest."""
    first = F.greatest(F.lit(0), F.size("grams") - F.expr(f"int((size * {num} + {den - 1}) div {den})") + 1)
    keys = ordered.select("node", F.explode(F.slice("grams.gram", F.lit(1), first)).alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = salted_join(keys, least.select("key", "a"), ["key"], hot_keys(least, ["key"], grams), "node")
    return components(met.where("node != a").select("a", F.col("node").alias("b")).distinct()).withColumnRenamed("component", "hub")


def differences(ordered: DataFrame, family: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(hub, node, size, fragment, own, theirs, partial, delta): for each fragment the lengths of the node's
    segment and of its hub's, their overlap, and what only one of the two has."""
    places = pivots(ordered)
    struct = "named_struct('class', {}, 'gram', {}L)"
    marks = [struct.format(c, g if g > -(1 << 63) else "-9223372036854775807") for c, g in places]
    lows, highs = [None, *marks], [*marks, None]
    cut = []
    for low, high in zip(lows, highs, strict=True):
        tests = [f"x >= {low}"] * (low is not None) + [f"x < {high}"] * (high is not None)
        cut.append(f"transform(filter(grams, x -> {' and '.join(tests)}), x -> x.gram)" if tests else "grams.gram")
    parts = ordered.join(family, "node").select("node", "hub", "size", F.posexplode(F.expr(f"array({', '.join(cut)})")).alias("fragment", "segment"))
    parts = stored(parts, "segments")
    hubs = parts.where("node = hub").select("hub", "fragment", F.col("segment").alias("hubs"))
    met = salted_join(parts, hubs, ["hub", "fragment"], hot, "node")
    delta = F.concat(F.array_except("segment", "hubs"), F.array_except("hubs", "segment"))
    lengths = [F.size(x).cast("long").alias(y) for x, y in (("segment", "own"), ("hubs", "theirs"), (F.array_intersect("segment", "hubs"), "partial"))]
    out = stored(met.select("hub", "node", "size", "fragment", *lengths, delta.alias("delta")), "differences")
    discard(parts)
    return out


def near_links(sums: DataFrame, num: int, den: int, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """From sums (hub, node, size, alone, apart): links that follow from distances to the hub alone, and
    sums with near, whether a node is in one.

    Sets at distances e and f from one place are at most e + f apart. Where that is near enough for two
    nodes, it is so for each of them and the node of least (num + den) e - (den - num) size.
    """
    scored = sums.withColumn("score", F.col("apart") * (num + den) - F.col("size") * (den - num))
    best = scored.groupBy("hub").agg(F.min(F.struct("score", "node")).alias("best"))
    both = salted_join(scored, best, ["hub"], hot, "node").withColumn("near", F.col("score") + F.col("best.score") <= 0)
    both = stored(both, "scored")
    links = both.where(F.col("near") & (F.col("node") != F.col("best.node"))).select(F.col("best.node").alias("a"), F.col("node").alias("b"))
    return links, both.withColumn("near", F.col("near") | (F.col("node") == F.col("best.node"))).select("hub", "node", "size", "alone", "apart", "near")


def _prefixes(elements: DataFrame, num: int, den: int, rows: int) -> DataFrame:
    """From elements (hub, node, size, alone, apart, asked, element), `rows` of them, the keys of each node's
    prefixes: key, node, size, apart, rest (how many of its elements follow). What a node has alone comes
    first in the order; elements that no asked node has are no keys."""
    often = elements.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("wanted"))
    often = often.select("hub", "element", "n", "wanted")
    met = salted_join(elements.drop("asked"), often, ["hub", "element"], hot_keys(often, ["hub", "element"], rows), "node")
    own = Window.partitionBy("node")
    ranked = met.withColumn("rank", F.row_number().over(own.orderBy("n", "element")))
    ranked = ranked.withColumn("rest", F.col("apart") - F.col("alone") - F.col("rank")).withColumn("rank", F.col("rank") + F.col("alone"))

    def band(e: Column) -> Column:
        return F.floor(F.log(F.greatest(e, F.lit(1)).cast("double")) / math.log(1.25)).cast("int")

    reach = F.expr(f"size * {den - num} div {num}")  # no link is wider apart
    ranked = ranked.where("n > 1 and wanted").withColumn("reach", reach).withColumn("band", band(F.col("apart")))
    others = F.explode(F.sequence(band(F.col("apart") - F.col("reach")), band(F.col("apart") + F.col("reach")))).alias("other")
    spread = ranked.select("hub", "node", "size", "apart", "element", "rank", "rest", "reach", "band", others)
    low = F.floor(F.pow(F.lit(1.25), F.col("other")) - 1e-6).cast("long")
    need = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("apart") + F.greatest(low, F.lit(1)) - F.col("reach")) / 2.0))
    cut = spread.where(F.col("rank") <= F.col("apart") - need + 1)
    # one key for an element and a pair of bands, whichever of the two the node is in
    key = F.xxhash64("hub", "element", F.least("band", "other"), F.greatest("band", "other")).alias("key")
    return cut.select(key, "node", "size", "apart", "rest").distinct()


def _possible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y, sx, sy, ex, ey, rx, ry) whose sizes allow a link, and which can share elements enough if
    the key is the first that they share: every linked pair stays under that key."""
    fit = (F.col("sx") * den >= F.col("sy") * num) & (F.col("sy") * den >= F.col("sx") * num)
    most = (F.col("ex") + F.col("ey") - 2 * (1 + F.least("rx", "ry"))) * (num + den)
    return pairs.where(fit & (most <= (F.col("sx") + F.col("sy")) * (den - num))).select("x", "y", "sx", "sy", "ex", "ey").distinct()


def far_links(sums: DataFrame, deltas: DataFrame, known: DataFrame, num: int, den: int, hot: DataFrame | None) -> DataFrame | None:
    """Links in which a node takes part that is not near.

    x and y are e + f - 2o apart, if their differences from the hub share o elements. So a link asks for
    an o that grows with e and f, and prefixes of the differences, the rarest elements first, meet in
    at least one element. Prefixes are cut for each band of the other's distance.
    """
    spark = sums.sparkSession
    opened = sums.where(~F.col("near")).select("hub").distinct()
    members = stored(salted_join(sums, opened, ["hub"], hot, "node", "left_semi"), "members")
    elements = stored(deltas.select("node", F.explode("delta").alias("element")).join(members.withColumn("asked", ~F.col("near")).drop("near"), "node"), "elements")
    rows = stored(_prefixes(elements, num, den, elements.count()), "prefixes")
    groups = known.withColumnRenamed("component", "group")
    parts = _open(rows, groups)
    links = asked = None
    for k in range(ROUNDS + 1):
        pairs = _possible(_star_pairs(parts) if k < ROUNDS else _pairs_across(parts), num, den)
        pairs = stored(pairs if asked is None else pairs.join(asked, ["x", "y"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        asked = pairs.select("x", "y") if asked is None else asked.unionByName(pairs.select("x", "y"))
        new = stored(_verified(pairs, deltas, num, den), "verified")
        links = new if links is None else links.unionByName(new)
        if k < ROUNDS:
            chain = groups.select(F.col("group").alias("a"), F.col("node").alias("b")).unionByName(links)
            old, parts = parts, _open(rows, components(chain).withColumnRenamed("component", "group"))
            discard(old)
        release(spark)
    discard(members, elements, rows, parts)
    return links


def _open(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (key, node, size, apart, rest) with the node's group, of keys that hold several groups."""
    grouped = rows.join(groups.select("node", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    several = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    met = salted_join(grouped, several.select("key"), ["key"], hot_keys(several, ["key"], rows.count()), "node", "left_semi")
    return stored(met.select("key", "node", "size", "apart", "rest", "group"), "open-prefixes")


def _star_pairs(members: DataFrame) -> DataFrame:
    """The key's smallest node with one node of each other group."""
    one = members.groupBy("key", "group").agg(F.min(F.struct("node", "size", "apart", "rest")).alias("v"))
    first = one.groupBy("key").agg(F.min("v").alias("u"))
    both = one.join(first, "key").where("u.node != v.node")
    return both.select(*(F.col(f"{side}.{name}").alias(f"{to}{at}") for side, at in (("u", "x"), ("v", "y")) for name, to in (("node", ""), ("size", "s"), ("apart", "e"), ("rest", "r"))))


def _pairs_across(members: DataFrame) -> DataFrame:
    x, y = (members.select("key", F.col("node").alias(at), *(F.col(name).alias(f"{to}{at}") for name, to in (("size", "s"), ("apart", "e"), ("rest", "r"), ("group", "g")))) for at in "xy")
    return x.join(y, "key").where("gx != gy and x < y")


def _verified(pairs: DataFrame, deltas: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that are linked: overlaps of their differences, counted by fragment and summed."""
    of_x = deltas.select(F.col("node").alias("x"), "fragment", F.col("delta").alias("dx"))
    of_y = deltas.select(F.col("node").alias("y"), "fragment", F.col("delta").alias("dy"))
    counted = pairs.join(of_x, "x").join(of_y, ["y", "fragment"]).select("x", "y", "sx", "sy", "ex", "ey", F.size(F.array_intersect("dx", "dy")).cast("long").alias("partial"))
    shared = counted.groupBy("x", "y", "sx", "sy", "ex", "ey").agg(F.sum("partial").alias("o"))
    apart = F.col("ex") + F.col("ey") - 2 * F.col("o")
    return shared.where(apart * (num + den) <= (F.col("sx") + F.col("sy")) * (den - num)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def link_counts(sums: DataFrame, deltas: DataFrame, num: int, den: int, hot: DataFrame | None) -> DataFrame:
    """(node, n_links): how many other nodes each node is linked with, exactly.

    Where any two distances of a family are near enough, all its nodes are linked. Other families are
    measured from their middle instead of the hub: what more than half of the nodes differ from the hub
    in is changed in all differences. Then pairs whose distances to the middle are near enough are
    counted by distance, without a row for a pair; any other link asks for a shared element of the
    differences, and such pairs meet on prefixes and are compared.
    """

    def scored(df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.col("apart") * (num + den) - F.col("size") * (den - num))

    first = scored(sums).select("hub", "node", "size", "alone", "apart", "score")
    top = first.groupBy("hub").agg(F.count(F.lit(1)).alias("k"), F.max("score").alias("most"))
    # two times the largest is at least the sum of the two largest
    both = stored(salted_join(first, top, ["hub"], hot, "node"), "with-most")
    closed = both.where("most <= 0").select("node", (F.col("k") - 1).alias("n_links"))
    opened = both.where("most > 0").drop("most")
    if opened.isEmpty():
        return closed
    sizes = opened.select("hub", "k").distinct()
    own = salted_join(deltas.select("hub", "node", "fragment", F.explode("delta").alias("element")), sizes.select("hub"), ["hub"], hot, "node", "left_semi")
    often = own.groupBy("hub", "fragment", "element").agg(F.count(F.lit(1)).alias("n")).join(sizes, "hub").where(2 * F.col("n") > F.col("k"))
    major = stored(often.groupBy("hub", "fragment").agg(F.collect_list("element").alias("major")), "major")
    # whole segments are changed at once: a row for each node and fragment, none for a changed element
    flipped = salted_join(deltas.select("hub", "node", "fragment", "delta"), sizes.select("hub"), ["hub"], hot, "node", "left_semi")
    flipped = salted_join(flipped, major, ["hub", "fragment"], hot, "node", "left").withColumn("major", F.coalesce("major", F.array().cast("array<bigint>")))
    moved = F.concat(F.array_except("delta", "major"), F.array_except("major", "delta"))
    moved = stored(flipped.select("hub", "node", "fragment", moved.alias("delta")), "moved-segments")
    apart = moved.groupBy("node").agg(F.sum(F.size("delta")).alias("moved"))
    members = opened.select("hub", "node", "size", "alone").join(apart, "node", "left").withColumn("apart", F.col("alone") + F.coalesce("moved", F.lit(0))).drop("moved")
    members = stored(scored(members), "moved")
    held = members.groupBy("hub", "score").agg(F.count(F.lit(1)).alias("c"))
    marks = held.select("hub", F.col("score").alias("v"), F.lit(0).alias("ask"), "c", "score").unionByName(held.select("hub", (-F.col("score")).alias("v"), F.lit(1).alias("ask"), F.lit(0).cast("long").alias("c"), "score"))
    below = F.sum("c").over(Window.partitionBy("hub").orderBy("v", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = marks.withColumn("below", below).where("ask = 1").select("hub", "score", "below")
    scores = held.select("hub", "score", F.col("c").alias("n"))
    near = salted_join(members, counted, ["hub", "score"], hot_keys(scores, ["hub", "score"], members.count()), "node")
    near = near.select("node", (F.col("below") - F.when(F.col("score") <= 0, 1).otherwise(0)).alias("n_links"))
    elements = moved.select("node", F.explode("delta").alias("element")).join(members.select("hub", "node", "size", "alone", "apart", (F.col("score") > 0).alias("asked")), "node")
    elements = stored(elements, "elements")
    keyed = stored(_prefixes(elements, num, den, elements.count()), "prefixes")
    pairs = _possible(_pairs_across(keyed.withColumn("group", F.col("node"))), num, den)
    wide = (F.col("ex") + F.col("ey")) * (num + den) > (F.col("sx") + F.col("sy")) * (den - num)
    pairs = stored(pairs.where(wide), "pairs")
    found = _verified(pairs, moved, num, den)
    far = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    return closed.unionByName(near.unionByName(far).groupBy("node").agg(F.sum("n_links").alias("n_links")))


def classes(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text", counted: bool = True) -> DataFrame:
    """A row for each row of df: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links of similarity num / den or more) and, if counted, n_links, how many different sets its own is
    linked with."""
    with scratch_scope(df.sparkSession) as keep:
        return _classes(df, n, num, den, doc_id, text, counted, keep)


def _classes(df: DataFrame, n: int, num: int, den: int, doc_id: str, text: str, counted: bool, keep) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    end = share_of(num, den)
    slim = keep(stored(docs.mapInArrow(lean(lambda batches: _signatures(batches, n, end)), "doc_id long, size long, few long, one long, two long"), "signatures"))
    same = slim.where("size > 0 and doc_id is not null").groupBy("one", "two", "size").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"), F.max("few").alias("few"))
    same = stored(same, "same")
    nodes = stored(same.groupBy("node").agg(F.min(F.struct("one", "two", "size", "few")).alias("s")).select("node", "s.one", "s.size", "s.few"), "nodes")
    known = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("few"), F.lit(0)).alias("few")).first()
    alive = stored(company(docs, nodes, n, num, den, known["n"], known["few"]), "alive")
    release(spark)
    left = alive.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("grams")).first()
    repeats = not slim.groupBy("doc_id").count().where("count > 1").isEmpty()
    ordered = ordered_sets(docs, alive, n, left["n"], left["grams"], repeats)
    family = stored(families(ordered, num, den, left["grams"]), "families")
    release(spark)
    hot = hot_keys(family.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), ["hub"], left["n"])
    hot = stored(hot, "hot") if hot is not None else None
    deltas = differences(ordered, family, hot)
    discard(ordered)
    # the partial overlaps of each pair of node and hub, summed, are what its distance is made of
    sums = deltas.groupBy("hub", "node", "size").agg(F.sum("own").alias("own"), F.sum("theirs").alias("theirs"), F.sum("partial").alias("overlap"))
    sums = sums.select("hub", "node", "size", (F.col("size") - F.col("own")).alias("alone"), (F.col("size") + F.col("theirs") - 2 * F.col("overlap")).alias("apart"))
    links, sums = near_links(stored(sums, "sums"), num, den, hot)
    release(spark)
    far = far_links(sums, deltas, components(links), num, den, hot)
    found = components(links if far is None else links.unionByName(far))
    if counted:
        found = found.join(link_counts(sums.drop("near"), deltas, num, den, hot), "node", "full")
    info = keep(stored(same.join(found, "node", "left"), "labelled"))
    columns = [F.col("doc_id"), "size", "one", "two"]
    out = salted_join(slim.select(*columns), info, ["one", "two", "size"], hot_keys(info, ["one", "two", "size"], slim.count()), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if counted else []
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), *links)


def representatives(df: DataFrame, **options) -> DataFrame:
    """The rows of df that stand for their component: those whose doc_id is its smallest; rows without
    a doc_id stay."""
    with scratch_scope(df.sparkSession) as keep:
        found = classes(df, counted=False, **options)
        gone = keep(stored(found.where("component_id is not null and doc_id != component_id").select("doc_id").distinct(), "copies"))
    rows = gone.count()
    return joined_small(df, gone, "doc_id", "left_anti", rows, MOST_BROADCAST)
