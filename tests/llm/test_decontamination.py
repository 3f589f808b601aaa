"""Leaks of benchmark items, planted by hand."""

import random

from siteglass.llm import decontamination

ITEM = "A farmer named Maria has 12 apples and gives 5 apples to her friend Peter after walking 3 km to the market with Maria the dog."
OTHER = "Explain in a few words why the ancient harbour town was given up by its people long before the river changed its course."


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(d, b).collect()}
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in decontamination.clean(d, b).collect())
    return got, kept


def test_copies_parameters_and_clean_texts(spark):
    changed = ITEM.replace("Maria", "Anna").replace("12", "40").replace("5 ", "7 ").replace("Peter", "Tom").replace("3 km", "9 miles")
    torn = ITEM.replace("named Maria", "named Anna").replace("12", "40")
    docs = [
        (1, "Some words before it. " + ITEM + " And some words after it."), (2, f"So {ITEM.lower()} indeed"), (3, "Before.\n" + changed), (4, torn), (5, OTHER.upper()),
        (6, "Entirely different words about farmers, markets, apples and dogs that were never part of any test at all, as far as anybody knows."),
        (7, None), (8, ""), (9, "Short one."), (1, "Some words before it. " + ITEM + " And some words after it."), (None, OTHER), (10, OTHER[:70]), (11, "word " * 30000 + OTHER),
    ]
    got, kept = run(spark, docs, [(100, ITEM), (200, OTHER), (300, None), (400, ""), (500, "Too short here"), (600, OTHER)])
    assert {k for k in got if k[1] in (100, 200)} == {(1, 100), (2, 100), (3, 100), (4, 100), (5, 200), (None, 200), (11, 200)} | ({(10, 200)} if (10, 200) in got else set())
    # of the torn copy the windows that are the item's word for word count, and only they
    assert got[3, 100].reparameterised and not got[1, 100].reparameterised and not got[4, 100].reparameterised
    assert got[4, 100].found < got[1, 100].found
    assert [k for k in kept if k != 10] == [6, 7, 8, 9]


def test_short_items_and_empty_tables(spark):
    got, _ = run(spark, [(1, "He asked what is the tallest mountain then."), (2, "nothing")], [(1, "What is the tallest mountain?")])
    assert set(got) == {(1, 1)}
    assert run(spark, [(1, "a b c d e f g h i j")], [])[1] == [1]
    assert run(spark, [], [(1, OTHER)])[0] == {}


def test_windows_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ra", "to", "mi", "ske") for b in ("na", "lo", "ri", "pu", "da")]
    items = [(k, " ".join(rng.choice(words) for _ in range(20))) for k in range(8)]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if rng.random() < 0.6:
            source = rng.choice(items)[1].split()
            a = rng.randrange(15)
            text[3:3] = source[a : a + rng.randrange(6, 20)]
        docs.append((d, " ".join(text)))

    def grams(t):
        w = t.split()
        return {tuple(w[k : k + 8]) for k in range(len(w) - 7)}

    want = {(d, i) for d, t in docs for i, x in items if len(grams(t) & grams(x)) >= 0.3 * len(grams(x)) and grams(t) & grams(x)}
    got, kept = run(spark, docs, items)
    assert set(got) == want
    assert kept == sorted(d for d, _ in docs if d not in {k for k, _ in want})


def test_one_edited_slot_leaves_the_verbatim_windows(spark):
    edited = ITEM.replace("named Maria", "named Anna")
    scattered = "A farmer named Anna has 12 apples and gives 5 apples to nobody. Some other text with Maria the dog."
    got, kept = run(spark, [(1, edited), (2, scattered), (3, ITEM)], [(100, ITEM)])
    # of 19 windows those at 0 to 3 hold the edited name, which is torn: they alone do not count
    assert set(got) == {(1, 100), (3, 100)} and kept == [2]
    assert got[1, 100].found == 15 and got[1, 100].windows == got[3, 100].found == 19 and not got[1, 100].reparameterised


def plain_leaks(docs, items, share=0.3):
    """Templates, windows and slots in plain Python: (document, item): found windows."""
    import regex

    def cut(text):
        """Windows of both templates: (place, template, slots)."""
        tokens = []
        for m in regex.finditer(r"[\p{L}\p{M}]+|[0-9]+", text or ""):
            kind = "number" if m[0].isdigit() else "unit" if tokens and tokens[-1][0] == "number" and m[0].lower() in ("km", "miles") else "name" if regex.search(r"[\p{L}\p{N},;] $", text[: m.start()]) and regex.fullmatch(r"\p{Lu}\p{Ll}+", m[0]) else None
            tokens.append((kind, m[0].lower()))
        for kinds in (("number", "unit", "name"), ("number", "unit")):
            for k in range(len(tokens) - 7):
                some = tokens[k : k + 8]
                slots = tuple((kind, value) for kind, value in some if kind in kinds)
                yield k, tuple(f"<{kind}>" if kind in kinds else value for kind, value in some), slots, sum(kind not in kinds for kind, _ in some)

    out = {}
    for i, x in items:
        own = [(k, t, s) for k, t, s, literals in cut(x) if literals >= 5]
        for d, text in docs:
            met = [(k - p, p, s, o) for k, t, s, _ in cut(text) for p, u, o in own if t == u]
            stands = {}
            for shift, _, s, o in met:
                for (kind, theirs), (_, ours) in zip(s, o, strict=True):
                    stands.setdefault((shift, kind, ours), set()).add(theirs)
            torn = {shift for (shift, _, _), values in stands.items() if len(values) > 1}
            found = {p for shift, p, s, o in met if s == o or shift not in torn}
            if found and len(found) >= share * len({p for p, _, _ in own}):
                out[d, i] = len(found)
    return out


def test_templates_and_slots_against_a_plain_version(spark):
    rng = random.Random(11)
    names, verbs = ["Anna", "Boris", "Clara", "David", "Ines"], ["gives", "sends", "lends", "sells", "brings", "owes"]

    def sentence():
        """A phrase of a few words, names, numbers and units."""
        return f"and then {rng.choice(names)} {rng.choice(verbs)} {rng.randrange(3, 60)} {rng.choice(['pears', 'coins', 'km', 'miles'])} to {rng.choice(names)} near the {rng.choice(['mill', 'lake', 'gate'])}"

    def changed(text):
        """Other names and numbers, alike throughout or not."""
        to = {n: rng.choice(names) for n in names}
        words = [to[w] if w in to and rng.random() < 0.95 else str(int(w) + 2) if w.isdigit() and rng.random() < 0.8 else w for w in text.split()]
        return " ".join(words)

    items = [(k, "Once " + " ".join(sentence() for _ in range(rng.randrange(1, 4)))) for k in range(10)]
    docs = []
    for d in range(80):
        parts = [sentence() for _ in range(rng.randrange(3))]
        if rng.random() < 0.7:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([lambda x: x, changed, str.lower])(rng.choice(items)[1]))
        docs.append((d, " ".join(parts)))
    want = plain_leaks(docs, items)
    got, kept = run(spark, docs, items)
    assert {k: r.found for k, r in got.items()} == want and len(want) > 30
    assert kept == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_items_without_a_template_window_are_found_verbatim(spark):
    items = [(1, "3 5 7 9 11 13 15 17 19"), (2, "Is 12 km more than 7 miles?"), (3, "Why not?")]
    docs = [(1, "He wrote 3 5 7 9 11 13 15 17 19 on it"), (2, "He wrote 3 5 7 9 11 13 15 18 20 22 24 on it"), (3, "4 6 8 10 12 14 16 18 20 22"), (4, "So is 12 km more than 7 miles or so"), (5, "So is 14 km more than 8 miles or so"), (6, "Why not")]
    got, _ = run(spark, docs, items)
    assert {k for k in got} == {(1, 1), (4, 2)} and not any(r.reparameterised for r in got.values())
    listed = decontamination.unchecked(spark.createDataFrame([*items, (4, None)], "item_id long, text string")).collect()
    assert {(r["item"], r.tokens) for r in listed} == {(3, 2), (4, 0)}
