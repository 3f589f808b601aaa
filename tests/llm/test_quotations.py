"""Quotation linking on hand-made mail."""

from siteglass.llm import quotations

FIRST = "Shall we meet on Monday at noon?\n\nBring the blue folder with the plans."
SECOND = "On Tue, Jan 2, Ann wrote:\n> Shall we meet on Monday at noon?\n\nYes, Monday suits me well."
THIRD = "> > Shall we meet on Monday at noon?\n> Yes, Monday suits me well.\nGood.\n> bring the  blue folder with the plans.\nI have it here already."
OTHER = ">Yes, Monday suits me well.\nQuoted from elsewhere."


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_links_and_order(spark):
    rows = [(1, 0, "user", FIRST), (1, 1, "assistant", SECOND), (1, 2, "user", THIRD), (1, 3, None, "No quote > here."), (2, 0, "user", OTHER), (2, 1, "user", None), (3, 0, "user", "> unknown words quoted here\n\nHm."), (3, 1, "user", "")]
    got = {(r.conv_id, r.turn): r for r in quotations.conversations(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[1, 0].own == FIRST and (got[1, 0].depth, got[1, 0].root_turn) == (0, 0)
    assert got[1, 1].own == "Yes, Monday suits me well." and (got[1, 1].parent_conv, got[1, 1].parent_turn, got[1, 1].depth) == (1, 0, 1)
    third = got[1, 2]
    assert third.own == "Good.\nI have it here already." and third.max_level == 2 and (third.n_quotes, third.n_linked) == (3, 3)
    assert (third.parent_turn, third.depth, third.thread_conv, third.root_turn) == (1, 2, 1, 0)
    assert got[1, 3].own == "No quote > here." and got[1, 3].formatted == "<|user|>\nNo quote > here.\n"
    other = got[2, 0]
    assert (other.parent_conv, other.parent_turn, other.thread_conv, other.depth) == (1, 1, 1, 2)
    assert (got[2, 1].own, got[2, 1].depth) == ("", 0)
    assert (got[3, 0].n_quotes, got[3, 0].n_linked, got[3, 0].parent_conv, got[3, 0].own) == (1, 0, None, "Hm.")


def test_defined_cases(spark):
    rows = [(1, 0, "user", "one two three four"), (1, 0, "user", "one two three four"), (None, 1, "user", "> one two three four\nx"), (1, None, "user", "> one two three four\ny"), (1, 5, "user", "> one two three four\nz")]
    df = frame(spark, rows).selectExpr("*", "'clash' own", "1 depth")
    got = quotations.conversations(df).collect()
    assert len(got) == len(rows)
    assert [(r.parent_turn, r.depth) for r in got if r.turn == 5] == [(0, 1)]
    assert all(r.parent_conv is None for r in got if r.conv_id is None or r.turn is None)
    assert quotations.conversations(df.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [(1, 0, "user", "message number 0 here")] + [(1, k, "user", f"> message number {k - 1} here\nmessage number {k} here") for k in range(1, 40)]
    got = {r.turn: (r.depth, r.root_turn) for r in quotations.conversations(frame(spark, rows)).collect()}
    assert got == {k: (k, 0) for k in range(40)}


def plain_conversations(rows):
    """The same linking, message by message: (own, n_quotes, n_linked, parent, thread, depth, position)."""
    import re

    def level(line):
        head = re.match(r"[ \t]*(?:>[ \t]*)+", line)
        return (head[0].count(">"), line[head.end() :]) if head else (0, line)

    def parse(text):
        lines = [level(x) for x in (text or "").split("\n")]
        if not any(k for k, _ in lines):
            return text or "", []
        spans = []
        for place, (k, body) in enumerate(lines):
            if spans and spans[-1][1] == k:
                spans[-1][2].append(body)
            else:
                spans.append((place, k, [body]))
        own = [x[2][:-1] if k + 1 < len(spans) and re.fullmatch(r"(?i)\s*on\s.*\swrote\s*:\s*", x[2][-1]) else x[2] for k, x in enumerate(spans) if x[1] == 0]
        whole = re.sub(r"\n{3,}", "\n\n", "\n".join("\n".join(x) for x in own))
        return whole.strip(" \n\t\r"), [(k, "\n".join(body)) for _, k, body in spans if k]

    norm = lambda t: re.sub(r"[ \t\x0b\f\r\n]+", " ", t.lower()).strip(" ")
    lines = lambda t: [norm(x) for x in t.split("\n") if len(x.split()) >= 3]
    parsed = {(c, t): parse(x) for c, t, _, x in rows}
    filed = {}
    for at, (own, _) in sorted(parsed.items()):
        for h in {norm(own), *map(norm, re.split(r"\n\s*\n", own)), *lines(own)} if own else ():
            filed.setdefault(h, []).append(at)
    out = {}
    for (c, t), (own, quotes) in parsed.items():
        found = []
        asked = [(k, p) for k, p in quotes if norm(p)]
        for k, passage in asked:
            for rank, units in enumerate(([norm(passage)], lines(passage))):
                sources = []
                for h in units:
                    here = [x for x in filed.get(h, ()) if x[0] == c]
                    if here and here[0][1] < t:
                        sources.append(here[0])
                    elif filed.get(h) and filed[h][0][0] < c:
                        sources.append(filed[h][0])
                if sources:
                    found.append((-k, min(sources)))
                    break
        out[c, t] = (own, len(asked), len(found), max(found)[1] if found else None)
    result, threads = {}, {}
    for at in out:
        top, depth = at, 0
        while out[top][3]:
            top, depth = out[top][3], depth + 1
        threads.setdefault(top, []).append((depth, *at))
        result[at] = (*out[at], top, depth)
    return {at: (*x, sorted(threads[x[4]]).index((x[5], *at))) for at, x in result.items()}


def test_random_mail_against_a_plain_version(spark, monkeypatch):
    import random

    from siteglass.llm import common

    rng = random.Random(6)
    phrases = [f"{a} {b} {c}" for a in ("we", "they", "you") for b in ("met", "left", "know") for c in ("on Monday", "the Plan", "it  well", "")]
    rows = []
    for conv in range(12):
        for turn in range(rng.randrange(1, 9)):
            parts = []
            for _ in range(rng.randrange(1, 4)):
                lines = [rng.choice(phrases).strip() for _ in range(rng.randrange(1, 3))]
                if rows and rng.random() < 0.6:
                    source = rng.choice([r for r in rows if r[0] == conv] or rows)[3] or ""
                    mark = rng.choice(["> ", ">", ">> ", " > "])
                    lines = [*(["On Monday Ann wrote:"] if rng.random() < 0.3 else []), *(mark + (x.upper() if rng.random() < 0.2 else x) for x in source.split("\n")[: rng.randrange(1, 5)]), *lines]
                parts.append("\n".join(lines))
            rows.append((conv, turn, "user", rng.choice([None, "", "ok"]) if rng.random() < 0.05 else "\n\n".join(parts)))
    want = plain_conversations(rows)
    for least in (common.LEAST_HOT, 1):
        monkeypatch.setattr(common, "LEAST_HOT", least)
        got = quotations.conversations(frame(spark, rows)).collect()
        have = {(r.conv_id, r.turn): (r.own, r.n_quotes, r.n_linked, None if r.parent_conv is None else (r.parent_conv, r.parent_turn), (r.thread_conv, r.root_turn), r.depth, r.position) for r in got}
        assert have == want and sum(x[3] is not None for x in want.values()) > 15
    texts = {(r.thread_conv, r.root_turn, r.part): r.text for r in quotations.transcripts(quotations.conversations(frame(spark, rows)), most=3).collect()}
    for thread in {x[4] for x in want.values()}:
        members = sorted((x[6], x[0]) for x in want.values() if x[4] == thread)
        whole = "".join(texts[(*thread, k)] for k in range(-(-len(members) // 3)))
        assert whole == "".join(f"<|user|>\n{own}\n" for _, own in members)


def test_very_long_text(spark):
    long = "\n".join(f"line number {k} of it" for k in range(20_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "> line number 19999 of it\nSeen.")]
    got = {r.turn: r for r in quotations.conversations(frame(spark, rows)).collect()}
    assert got[0].own == long and (got[1].parent_turn, got[1].depth, got[1].position) == (0, 1, 1)
