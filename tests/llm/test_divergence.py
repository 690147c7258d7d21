import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import divergence
from scriptorium.llm.divergence import _terms, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, min_docs, top):
    """All kept terms of all groups, with zeros."""
    out = []
    rows = [(t, lang or "", source or "") for _, t, lang, source in rows]
    for lang in {r[1] for r in rows}:
        mine = [(words(t), s) for t, of, s in rows if of == lang]
        kept = [w for w, n in Counter(w for ws, _ in mine for w in set(ws)).items() if n >= min_docs]
        counts = {s: Counter(w for ws, of in mine if of == s for w in ws) for s in {s for _, s in mine}}
        whole = sum(counts.values(), Counter())
        price = lambda c, c_of: {w: 1 + 10**9 * (c[w] + 5) // (sum(c_of[x] for x in kept) + 5 * len(kept)) for w in kept}
        p, q = {s: price(c, c) for s, c in counts.items()}, price(whole, whole)
        for s in counts:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in counts if o != s)
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, some in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(some, 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def documents(rng):
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gämma", "Δelta", "eps-ilon", "x1y", "ζ"]) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "z", None])) for i in range(80)]
    return rows + rows[:9] + [(90, None, "en", "a"), (91, "", "xx", "only"), (92, None, "xx", "other"), (93, "rare", "yy", "a"), (94, "beta " * 4000, "en", "hot"), (95, "999 --", "en", "wordless")]


def test_against_dense_tables(spark):
    rows = documents(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(source_divergence(df, min_docs=4, top_terms=3)) == brute(rows, 4, 3)


def test_small_chunks_and_flushes_change_nothing(spark, monkeypatch):
    rows = documents(random.Random(4))
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "ROWS", 5)
    assert got(source_divergence(spark.createDataFrame(rows, SCHEMA), min_docs=3, top_terms=2)) == brute(rows, 3, 2)


def test_empty_table_and_clashing_columns(spark):
    assert got(source_divergence(spark.createDataFrame([], SCHEMA))) == []
    rows = documents(random.Random(5))
    extra = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA + ", n long, term string, gid long, p long, item string")
    assert got(source_divergence(extra, min_docs=30)) == brute(rows, 30, 50)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ é9 Δ\n-", max_size=60), st.integers(1, 9))
def test_terms_do_not_depend_on_chunks(text, chunk):
    before, divergence.CHUNK = divergence.CHUNK, chunk
    try:
        assert [t.decode() for some in _terms(text.encode()) for t in some] == words(text)
    finally:
        divergence.CHUNK = before
