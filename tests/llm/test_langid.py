import zlib

from scriptorium.llm.langid import BUCKETS, Model, codewords, keep_identified, language_id, letter_table, trigram_counts

TEXT = {"aa": "the house and the river run along the hills", "bb": "el perro come la cena en su casa vieja", "cc": "der hund und die katze schlafen unter dem tisch"}
SCHEMA = "doc_id long, text string, lang string, score string, source string"


def rows(n):
    out = []
    for i in range(n):
        lang = sorted(TEXT)[i % 3]
        words = TEXT[lang].split()
        out.append((i, " ".join(words[(i * k) % len(words)] for k in range(2, 22)), lang, "clash", "s"))
    return out


def test_codewords_are_far_apart():
    for n in (1, 2, 4, 5, 30):
        c = codewords(n)
        assert len(c) == n
        for i in range(n):
            for j in range(i):
                assert (c[i] != c[j]).sum() * 2 >= c.shape[1]


def test_letters():
    assert trigram_counts("123 !? \n") is None and trigram_counts("") is None
    assert trigram_counts("É").sum() == 1
    assert letter_table()[ord("ß")]


def test_held_out_accuracy(spark):
    data = rows(300) + [(1000, None, "aa", "", ""), (1001, "123 ---", "bb", "", ""), (None, TEXT["bb"], "bb", "", ""), (1002, TEXT["aa"], None, "", ""), (1003, "x", "aa", "", ""), (1004, (TEXT["cc"] + " ") * 5000, "cc", "", ""), (5, rows(6)[5][1], "cc", "", "")]
    got = language_id(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    for i, _, lang, *_ in data[:300]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= by[i].score <= 1
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(by[r.doc_id].lang_pred == sorted(TEXT)[r.doc_id % 3] for r in held) >= 0.97 * len(held)
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1000].score == 0
    assert by[None].lang_pred == "bb" and not by[None].held_out and by[1004].lang_pred == "cc"


def test_without_labels_and_rows(spark):
    df = spark.createDataFrame([(1, "abc", None, "", ""), (2, None, None, "", "")], SCHEMA)
    assert {r.lang_pred for r in language_id(df).collect()} == {"und"}
    assert language_id(df.limit(0)).collect() == []
    assert [r.doc_id for r in keep_identified(df).collect()] == [1]


def test_filter_keeps_columns(spark):
    df = spark.createDataFrame(rows(40) + [(100, "...", "aa", "", "")], SCHEMA)
    kept = keep_identified(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_one_language():
    import numpy as np

    m = Model(["aa"], np.ones((1, BUCKETS)), np.array([1]))
    best, score, _ = m.predict(np.stack([trigram_counts("hello")]))
    assert best[0] == 0 and score[0] == 1


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), int(rng.integers(2, 8)))) for _ in range(n))


def test_texts_in_no_learned_language_are_rejected(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, ("aeioustr", "bcdfghaz")[i % 2], 60), ("x", "y")[i % 2], 0.5) for i in range(400)]
    junk = [(1000 + i, prose(rng, "жщыэю", 60), None, 0.5) for i in range(40)]
    mixed = [(2000, rows[0][1] + " " + rows[1][1], None, 0.5), (2001, rows[0][1][:5], None, 0.5)]
    kept = {r.doc_id for r in keep_identified(spark.createDataFrame(rows + junk + mixed, "doc_id long, text string, lang string, score double")).collect()}
    assert kept >= {r[0] for r in rows + mixed}
    assert len(kept & {r[0] for r in junk}) == 0


def test_rare_languages_are_learned(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(i, prose(rng, "aeioustr", 30), "common") for i in range(3000)] + [(9000 + i, prose(rng, "bcdfghaz", 30), "rare") for i in range(6)]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=50).collect()
    assert {r.lang_pred for r in got if r.doc_id >= 9000} == {"rare"}


def test_prediction_against_brute_force(spark):
    """The nearest codeword by its weighted loss, one text and one bit at a time."""
    import math

    import numpy as np

    from scriptorium.llm.langid import MARGIN_SCALE, identify, train

    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, ("aeiou", "bcdfgae", "klmnio")[i % 3], 1 + i % 40), "abc"[i % 3]) for i in range(200)] + [(500, "", "a"), (501, "12", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    for r in identify(docs, model).collect():
        counts = trigram_counts(r.text)
        if counts is None:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        margins = [sum(float(c) * float(model.weights[i, b]) for i, c in enumerate(counts) if c) / float(counts.sum()) for b in range(model.codes.shape[1])]
        loss = {lang: sum(math.log1p(math.exp(-MARGIN_SCALE * m * int(code[b]))) * model.reliability[b] for b, m in enumerate(margins)) for lang, code in zip(model.languages, model.codes)}
        assert abs(loss[r.lang_pred] - min(loss.values())) < 1e-5
        assert abs(r.known - sum(float(c) for i, c in enumerate(counts) if model.known[i]) / float(counts.sum())) < 1e-6
