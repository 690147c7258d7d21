import zlib

import numpy as np

from scriptorium.llm.toxicity import FTRL, Features, _packed, fit, operating_point, toxicity


def data(n=900):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocab, rng.integers(5, 80)))
        bad = i % 6 == 0
        if bad:
            for w in rng.choice(["vile", "foul", "nasty"], 2):
                words.insert(int(rng.integers(len(words))), w)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = data()
    docs += [(5000, None, ""), (5001, "", ""), (None, "vile foul nasty", ""), (5002, "w1 " * 100_000 + "vile foul", ""), (3, docs[3][1], "")]
    labels += [(None, 1), (7777, None), (8888, 1), (3, 0)]
    d, t = frames(spark, docs, labels)
    got = toxicity(d, t).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.5 and by[None].predicted == 1 and by[5002].predicted == 1


def test_weights_are_sparse_and_repeatable():
    docs, labels = data(300)
    rows = [(i, _packed(Features(), t), y) for (i, t, _), (_, y) in zip(docs, labels)]
    a, b = fit(rows), fit(rows[::-1])
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and len(a[0]) < 500
    f, w = Features(), np.zeros((1 << 20) + 1)
    w[a[0]] = a[1]
    assert w[f.of("vile")[0]] > 0


def test_rates_are_per_coordinate():
    m = FTRL()
    for _ in range(5):
        m.learn(np.array([1, 1 << 20]), 1)
    m.learn(np.array([2, 1 << 20]), 1)
    assert m.n[1] > m.n[2] > 0 and m.n[3] == 0


def test_no_labels(spark):
    docs, _ = data(10)
    d, t = frames(spark, docs, [])
    assert {r.score for r in toxicity(d, t).collect()} == {0.5}
    assert toxicity(d.limit(0), t).collect() == []


def test_operating_point_has_the_best_f1():
    rng = np.random.default_rng(2)
    for _ in range(50):
        m, y = rng.integers(-5, 6, 40) / 2, rng.integers(0, 2, 40)
        f1 = lambda t: 2 * (y[m >= t]).sum() / ((m >= t).sum() + y.sum())
        assert f1(operating_point(m, y)) == max(f1(t) for t in m)
    assert operating_point(np.zeros(3), np.ones(3)) == 0 == operating_point(np.zeros(0), np.zeros(0))


def test_stems_find_rare_compounds(spark):
    docs, labels = data(600)
    docs = [(i, t + (f" zornig{chr(97 + i % 23)}{chr(97 + i % 19)}" if y else ""), "") for (i, t, _), (_, y) in zip(docs, labels)]
    d, t = frames(spark, [(i, x.replace("vile", "w1").replace("foul", "w2").replace("nasty", "w3"), "") for i, x, _ in docs], labels)
    held = [r for r in toxicity(d, t).collect() if r.held_out]
    assert sum(r.predicted == dict(labels)[r.doc_id] for r in held) >= 0.97 * len(held)


def test_score_against_brute_force(spark):
    """The score of a row is the logistic of the weights of its different coordinates, whoever computes it."""
    from scriptorium.llm.toxicity import train

    docs, labels = data(200)
    d, t = frames(spark, docs, labels)
    at, w = train(d, t)
    weight = dict(zip(at.tolist(), w.tolist()))
    for r in toxicity(d, t).collect():
        margin = weight.get(1 << 20, 0.0) + sum(weight.get(x, 0.0) for x in set(Features().of(docs[r.doc_id][1]).tolist()))
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-9
