"""What a task holds does not grow with the rows of a record batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm import decontam, exact_dedup, simhash
from scriptorium.llm.common import slices


def task(spark, monkeypatch, build):
    """The function over record batches that ``build`` of a table of documents hands to Spark."""
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    return build(docs)


def texts(n, words):
    rng = np.random.default_rng(7)
    return [" ".join(f"w{x}" for x in rng.integers(0, 100_000, words)) for _ in range(n)]


def peak(run, batch):
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_slices_are_all_rows_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, hi), pa.int64())], names=["id"]) for lo, hi in ((0, 1201), (1201, 1201), (1201, 1203))]
    got = list(slices(iter(batches)))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(1203))
    assert [b.num_rows for b in got] == [500, 500, 201, 2]


def test_shingle_sets_are_made_for_a_slice_at_a_time(spark, monkeypatch):
    n, held = 3000, texts(3000, 30)
    ids = pa.array(range(n), pa.int64())
    run = task(spark, monkeypatch, lambda docs: simhash._set_rows(docs, "doc_id", "text", 5))
    out = list(run(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(held)], names=["id", "text_hash", "text"])])))
    assert max(b.num_rows for b in out) <= 500
    rows = [x for b in out for x in b.column(0).to_pylist() if x is not None]
    assert rows == list(range(n))  # whole, in order
    assert [x for b in out for x in b.column(3).to_pylist() if x is not None] == [len(np.unique(simhash.shingle_hashes(t, 5))) for t in held]


def test_tries_hold_the_texts_of_a_slice_beside_their_own():
    text = b"x" * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), pa.array([5] * 10_000, pa.int64()), pa.array([text] * 10_000, pa.binary())], names=["id", "h", "content"])
    run = exact_dedup._map_tries(False, 0, 1 << 20)
    assert peak(run, batch) < 5 << 20  # the copies of the batch are 20 MB
    (out,) = run(iter([batch]))
    assert out.column("copies").to_pylist() == [10_000] and out.column("owner").to_pylist() == [0]


def test_texts_are_searched_for_items_a_slice_at_a_time(spark, monkeypatch):
    n = 6000
    ids = pa.array(range(n), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts(n, 200))], names=["id", "text_hash", "text"])
    run = task(spark, monkeypatch, lambda docs: decontam._hits(docs.select(F.lit(0).alias("id"), F.lit(0).alias("text_hash"), "text"), np.zeros(1 << 13, np.uint8), [(True, 13), (False, 8)]))
    assert peak(run, batch) < 30 << 20
