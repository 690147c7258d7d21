import numpy as np
import pytest
import xxhash

from scriptorium.llm import simhash
from scriptorium.llm.components import connected_components
from scriptorium.llm.simhash import fingerprint, near_duplicates, simhash_components

SCHEMA = "doc_id long, text string, component_id string, f0 string"


def brute(rows, k=3, limit=2):
    def print_of(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [print_of(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= limit and comp[j] < comp[i]:
                    comp[i] = comp[j]
                    changed = True
    least = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted(((d, p, least.get(c)) for (d, _), p, c in zip(rows, prints, comp)), key=str)


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = simhash_components(df, **options).collect()
    return sorted(((r["id"], r["f0"] % (1 << 64), r["component_id"]) for r in out), key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        words = list(rng.choice(vocab, 300))
        for _ in range(6):
            rows.append((n, " ".join(words)))
            n += 1
            words[rng.integers(300)] = "edit"
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one"), (None, "alone and null"), (0, rows[0][1])]
    assert result(spark, rows) == brute(rows)


def test_dense_cells_lose_no_link(spark):
    base = " ".join(f"t{i}" for i in range(60))
    rows = [(i, base + f" tail{i}") for i in range(300)]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_very_long_text():
    assert fingerprint("a b c " * 200_000, 3, 4)[0] == fingerprint("a b c " * 200_000, 3, 1)[0]


def test_near_duplicates_recall_and_precision(spark):
    rng = np.random.default_rng(2)
    vocab = [f"v{i}" for i in range(5000)]
    rows, n, pairs = [], 0, []
    for _ in range(60):
        words = list(rng.choice(vocab, 200))
        other = list(words)
        other[50], other[120] = "changed", "twice"  # Jaccard 186/206
        rows += [(n, " ".join(words)), (n + 1, " ".join(other))]
        pairs.append((n, n + 1))
        n += 2
    got = {r["id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(got[b] == a for a, b in pairs)
    assert caught >= 57
    assert all(got[a] == a for a, _ in pairs)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(5, i) for i in range(30)], [(3, 1), (1, 3), (9, 8), (8, 2)]])
def test_components(spark, links):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    comp = {}
    for a, b in links:
        ca, cb = comp.get(a, {a}), comp.get(b, {b})
        both = ca | cb
        for x in both:
            comp[x] = both
    assert got == {x: min(c) for x, c in comp.items() if x != min(c)}


def groups(spark, rows):
    return {r["id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_pairs_at_the_threshold(spark):
    rows = []
    for p in range(200):
        words = [f"t{p}w{i}" for i in range(8)]
        rows += [(4 * p, " ".join(words)), (4 * p + 1, " ".join([*words, "more"]))]  # 4 of 5
        words = [f"u{p}w{i}" for i in range(84)]
        rows += [(4 * p + 2, " ".join(words)), (4 * p + 3, " ".join([*words, *[f"v{p}w{i}" for i in range(20)]]))]  # 80 of 100
    got = groups(spark, rows)
    assert got == {d: d - d % 2 for d, _ in rows}


def test_repeats_in_a_text_do_not_part_equal_sets(spark):
    line = " ".join(f"line{i}" for i in range(12))
    pairs = [(" ".join(f"p{p}w{i}" for i in range(200)), p) for p in range(20)]
    rows = []
    for text, p in pairs:
        # the turn from the line to itself is in both
        rows += [(2 * p, f"{text} {line} {line}"), (2 * p + 1, f"{text} {' '.join([line] * 20)}")]
    # the print of a text is that of a shingle which most of its shingles repeat, whatever else it holds
    rows += [(100, "a " * 400 + " ".join(f"x{i}" for i in range(100))), (101, "a " * 400 + " ".join(f"y{i}" for i in range(100)))]
    got = groups(spark, rows)
    assert all(got[2 * p + 1] == 2 * p for _, p in pairs)
    assert got[100] == 100 and got[101] == 101


def test_pairs_inside_a_family_just_below_the_threshold(spark):
    base = " ".join(f"base{i}" for i in range(120))
    rows = []
    for p in range(60):
        own, other = ([f"own{p}x{i}" for i in range(15)], [f"other{p}x{i}" for i in range(14)])
        rows += [(2 * p, base + " " + " ".join(own)), (2 * p + 1, base + " " + " ".join([own[0], *other]))]
    # two of one pair share 117 of 145 shingles (0.807), two of different pairs 116 of 146 (0.795)
    got = groups(spark, rows)
    assert got == {d: d - d % 2 for d, _ in rows}


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for p in range(10):
        words = [f"p{p}w{i}" for i in range(1500)]
        rows.append((2 * p, " ".join(words)))
        words[rng.integers(1500)] = "edit"
        rows.append((2 * p + 1, " ".join(words)))
    near = [np.bitwise_count(np.uint64(x[0] ^ y[0])) <= 3 for x, y in zip(*[[[simhash._majority(np.unique(simhash.shingle_hashes(t, 5)))] for _, t in rows[i::2]] for i in (0, 1)])]
    cells = simhash._prefix_cells
    # without prefixes, what is found is found by fingerprints
    monkeypatch.setattr(simhash, "_prefix_cells", lambda *a: cells(*a).filter("false"))
    got = groups(spark, rows)
    assert sum(near) >= 3 and all(got[2 * p] == 2 * p and (got[2 * p + 1] == 2 * p or not near[p]) for p in range(10))
