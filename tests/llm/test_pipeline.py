import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm.common import cut
from scriptorium.llm.queries import oracle_sql, queries

ITEM = "the quick mill turns seven wheels before noon while three quiet bakers count each loaf that leaves the door"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(3000)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choice(vocab, 150)), "xx", ("a", "b", None)[i % 3], 0))
    t = [r[1] for r in rows]
    words = t[5].split()
    words[70] = "altered"
    extra = [(200, t[0]), (201, t[0]), (202, t[1]), (203, " ".join(words)), (204, t[9] + " " + ITEM + " " + t[10]), (205, "123 456"), (206, ""), (207, None), (208, "short one here"), (3, t[3])]
    return rows + [(d, x, "xx", "a", 0) for d, x in extra]


def brute(rows):
    """Which identifiers stay after each of the filtering stages."""
    live = [(d, t) for d, t, *_ in rows if t and re.search(r"[^\W\d_]", t)]
    stages = [sorted(d for d, _ in live)]
    first = {}
    for d, t in live:
        first[t] = min(d, first.get(t, d))
    live = sorted({(d, t) for t, d in first.items()})
    stages.append([d for d, _ in live])
    grams = {d: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in live}
    comp = {d: d for d, _ in live}
    for a, _ in live:
        for b, _ in live:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                comp[b] = min(comp[b], comp[a])
    live = [(d, t) for d, t in live if comp[d] == d]
    stages.append([d for d, _ in live])
    stages.append([d for d, t in live if ITEM not in t])
    return stages


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(rows)):
        columns = docs.columns
        docs = cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        assert sorted(r.doc_id for r in docs.collect()) == want, name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert mixed and all(0 < r.taken <= 2 * r.size for r in mixed)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries()} == set(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
    assert len(corpus_pipeline.STAGES) == 5 and F
