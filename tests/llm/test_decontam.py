import re

import numpy as np

from scriptorium.llm.decontam import Canonicaliser, contaminated, decontaminate

ITEM = "If a train leaves Boston at 60 miles per hour and another train leaves Denver at 80 miles per hour then how long until they meet on the way."
VARIANT = ITEM.replace("Boston", "Lyon").replace("Denver", "Paris").replace("60", "45").replace("80", "70")
BROKEN = ITEM.replace("60", "45").replace("80 miles", "80 km")


def run(spark, docs, items=((7, ITEM),), **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, kind string") if docs and len(docs[0]) == 4 else spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((tuple(r) for r in contaminated(d, b, **options).collect()), key=str), d, b


def test_verbatim_variant_and_clean(spark):
    docs = [(1, "Words before. " + ITEM + " Words after."), (2, "So. " + VARIANT), (3, "A train leaves and another one meets it at noon on the long way home."), (4, None), (5, ""), (None, ITEM), (6, "no names here at all " + ITEM.replace("Boston", "x").replace("Denver", "y").upper()), (1, "Words before. " + ITEM + " Words after.")]
    got, d, b = run(spark, docs)
    assert {(r[0], r[2], r[3]) for r in got} == {(1, 7, "verbatim"), (2, 7, "reparameterised"), (None, 7, "verbatim"), (6, 7, "verbatim")}
    kept = decontaminate(d, b).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "4", "5"] and any(r[0] == 6 for r in got)


def test_inconsistent_slots_are_no_match(spark):
    item = "the box holds 12 red and 12 blue and 12 green marbles in each of the rows"
    same = item.replace("12", "30")
    mixed = item.replace("12", "30", 1).replace("12", "31", 1)
    got, _, _ = run(spark, [(1, same), (2, mixed)], [(1, item)])
    assert [(r[0], r[3]) for r in got] == [(1, "reparameterised")]


def test_brute_force_on_random_text(spark):
    rng = np.random.default_rng(3)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "su", "to", "vi", "xo")]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, text(int(rng.integers(3, 40)))) for i in range(30)]
    docs = []
    for d in range(200):
        t = text(int(rng.integers(0, 120)))
        if d % 3 == 0:
            words = items[int(rng.integers(30))][1].split()
            a = int(rng.integers(0, max(1, len(words) - 13)))
            t += " " + " ".join(words[a : a + int(rng.integers(5, 40))]) + " " + text(5)
        docs.append((d, t))

    want = {(d, i, kind) for d, t in docs for i, x in items if (kind := holds(t, x))}
    got, _, _ = run(spark, docs, items)
    assert {(r[0], r[2], r[3]) for r in got if r[3] != "reparameterised"} == want and want
    # without placeholders a template differs from a copy in that its windows may have a gap between them
    assert {(r[0], r[2]) for r in got} == {(d, i) for d, t in docs for i, x in items if holds(t, x) or gathered(t, x)}


def holds(doc, item):
    """The rule for copies, word for word."""
    w, x = (re.findall(r"\d+(?:[.,]\d+)*|\w+", t.lower()) for t in (doc, item))
    n = min(13, len(x))
    if n and any(w[i : i + n] == x[j : j + n] for i in range(len(w) - n + 1) for j in range(len(x) - n + 1)):
        return "short" if len(x) < 5 else "verbatim"
    return None


def gathered(doc, item):
    """The rule for templates, over all offsets and without hashes."""
    canon = Canonicaliser()
    w, _, *doc_readings = canon.readings(doc)
    x, _, *item_readings = canon.readings(item)
    w, x = list(w), list(x)
    if len(x) < 5:
        return False
    n = min(8, len(x))
    # each of (hashes, kinds) with and without names at the beginnings of sentences
    docs, items = (list(zip(r[::2], r[1::2])) for r in (doc_readings, item_readings))
    fine = [[j for j in range(len(x) - n + 1) if (slot[j : j + n] != 0).sum() <= n // 2] for _, slot in items]
    windows = set().union(*fine)
    need = min(len(windows), max(1, min(13, len(x)) - n + 1))
    for offset in range(-len(x), len(w)):
        hit, filled = set(), set()
        for (g, slot), mine in zip(items, fine):
            for j in mine:
                at = slice(j + offset, j + offset + n)
                if 0 <= j + offset <= len(w) - n and any((h[at] == g[j : j + n]).all() and (kinds[at] != 0).sum() <= n // 2 for h, kinds in docs):
                    hit.add(j)
                    filled |= {(x[k].lower(), w[k + offset].lower()) for k in range(j, j + n) if slot[k]}
        if windows and len(hit) >= need and len({v for v, _ in filled}) == len(filled):
            return True
    return False


def test_names_at_the_beginning_of_a_sentence(spark):
    item = "Alice has 12 apples and buys 5 more apples today."
    docs = [(1, "Bob has 7 apples and buys 9 more apples today."), (2, "so Bob has 7 apples and buys 9 more apples today"), (3, "We saw. Bob has 7 apples and buys 9 more apples today"), (4, "Bob has 7 apples and sells 9 more pears today."), (5, "Alice has 7 apples and buys 9 more apples today."), (6, "bob has 7 apples and buys 9 more apples today")]
    got, d, b = run(spark, docs, [(1, item)])
    assert {(r[0], r[3]) for r in got} == {(1, "reparameterised"), (2, "reparameterised"), (3, "reparameterised"), (5, "reparameterised")}
    assert sorted(r.doc_id for r in decontaminate(d, b).collect()) == [4, 6]


def test_brute_force_on_questions_with_values(spark):
    rng = np.random.default_rng(5)
    names = ("Ann", "Bob", "Carl", "Dora")
    forms = ("the shop of {a} sells {x} pens and {y} cups while {b} keeps {x} more", "Then {a} walks {x} km and {b} walks {y} km before they meet at the old mill", "sum {x} {y} {x} {y} 7 8 9 {x} {y} 3 5", "so {a} has {x} apples")
    fill = lambda: str(rng.choice(forms)).format(a=rng.choice(names), b=rng.choice(names), x=rng.integers(2, 6), y=rng.integers(2, 6))
    items = [(i, fill()) for i in range(25)]
    docs = [(d, f"Words first, then {fill()} and so on. {fill()}") for d in range(60)]
    got, _, _ = run(spark, docs, items)
    assert {(r[0], r[2]) for r in got if r[3] == "verbatim"} == {(d, i) for d, t in docs for i, x in items if holds(t, x) == "verbatim"}
    # items that differ in values alone share a template, so compare documents
    assert {r[0] for r in got} == {d for d, t in docs if any(holds(t, x) or gathered(t, x) for _, x in items)}
    assert any(r[3] == "reparameterised" for r in got)


def test_copies_need_no_template(spark):
    numbers = "12 " * 9 + "7 8 9 11 plus 4 and 5 minus 3 equal 9"
    started = "The old clock of Vienna Prague Paris Rome Oslo Bonn strikes"
    docs = [(1, "Table: " + numbers + " end"), (2, 'Q: "' + started.lower() + ' now"'), (3, "yes"), (4, "\n".join(("we read " + started).split())), (5, "word " * 100_000 + started)]
    got, d, b = run(spark, docs, [(1, numbers), (2, started), (3, "Yes"), (4, "the"), (5, ""), (6, None)])
    assert {(r[0], r[2], r[3]) for r in got} == {(1, 1, "verbatim"), (2, 2, "verbatim"), (2, 4, "short"), (3, 3, "short"), (4, 2, "verbatim"), (4, 4, "short"), (5, 2, "verbatim"), (5, 4, "short")}
    assert [r.doc_id for r in decontaminate(d, b).collect()] == [3]


def test_empty_tables(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(1, ITEM)], [])[0] == []


def test_texts_read_together_are_as_texts_read_alone():
    rng = np.random.default_rng(6)
    pool = ["three", "Three", "THREE", "km", "KM", "Ab", "é", "É", "Σας", "ΟΔΟΣ", "İx", "ß", "²a", "１२", "12", "3.5", "1,000.", "7a", "a1", "_", ".", ",", "!", "?", "\n", " ", " ", " ", "𝔸b", "ǅa", "\ud800", "日本"]
    texts = ["", *["".join(rng.choice(pool, rng.integers(0, 30))) for _ in range(2000)], ""]
    canon = Canonicaliser()
    of, *together = canon.read(texts)
    begin, number = np.searchsorted(of, np.arange(len(texts) + 1)), {}
    for i, text in enumerate(texts):
        words, *alone = canon.readings(text)
        words = list(words)
        assert words == [w for w in re.findall(r"\d+(?:[.,]\d+)*|\w+|[.!?\n]", text) if w not in ".!?\n"]
        assert len(words) == begin[i + 1] - begin[i]
        assert all((x[begin[i] : begin[i + 1]] == y).all() for x, y in zip(together, alone))
        for w, h in zip(words, alone[0].tolist()):
            assert number.setdefault(w.lower().replace("ς", "σ"), h) == h
    assert len(set(number.values())) == len(number)
