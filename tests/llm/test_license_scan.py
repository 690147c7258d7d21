import re

import time

from scriptorium.llm.license_scan import NOTICES, PHRASES, scan_licenses, template_words

SCHEMA = "doc_id long, text string, labels string, words string"
MIT = NOTICES[0][0]


def run(spark, rows):
    return scan_licenses(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)).collect()


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


ROWS = [
    (1, "Released under the MIT License. Again: under-the mit LICENSE, cc by nc cc by nc"), (2, None), (3, ""), (4, "one two"), (5, "CC BY-NC 4.0"), (6, "Apache License, Version 2.0 é cc by nc"),
    (7, "under the mit under the mit license"), (None, "Released under the MIT License."), (1, "Released under the MIT License. Again: under-the mit LICENSE, cc by nc cc by nc"), (1, "another text, cc by nc"),
    (8, "word " * 100_000 + "cc by nc"), (9, "\u0130 CC BY NC \ud7ff 🔐 cc by nc"), (10, "\u212a cc by nc \u212aelvin UNDER THE MIT LICENSE\u00c9 under the mit license"), (11, "\x00cc\x00by\x7fnc\x80"),
]


def test_base_against_brute_force(spark):
    got = run(spark, ROWS)
    want = sorted(((d, *base(t)) for d, t in ROWS), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_edited_notice(spark):
    words = template_words(MIT)
    edited = words[:8] + ["inserted"] + words[8:]
    rows = [(1, "start " * 5 + " ".join(edited) + " end"), (2, " ".join(words[:6])), (3, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert got[1].labels == "mit" and got[1].n_base == 0 and 0.7 <= got[1].score < 1
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "gpl-3"


def test_empty(spark):
    assert run(spark, []) == []


def test_work_is_linear_in_length(spark):
    run(spark, [(1, "warm up")])
    start = time.perf_counter()
    (r,) = run(spark, [(1, "some words of prose " * 75_000 + "under the mit license")])
    assert (r.n_words, r.n_base, r.first_word) == (300_004, 1, 300_000)
    assert time.perf_counter() - start < 60
