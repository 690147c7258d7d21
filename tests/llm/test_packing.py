import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import packing
from scriptorium.llm.packing import Memo, WordEncoder, _fill, pack, packing_plan, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def encode():
    return WordEncoder(PATH)


def pieces(rows, size, tokenizer):
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out += [(doc, at // size, at, len(ids[at : at + size]), zlib.crc32(np.asarray(ids[at : at + size], "<u4").tobytes())) for at in range(0, len(ids), size)]
    return sorted(out, key=str)


def check(rows, out, size, tokenizer):
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = [tuple(r) for r in out.collect()]
    assert sorted((r[:5] for r in got), key=str) == pieces(rows, size, tokenizer)
    places = defaultdict(list)
    for r in got:
        places[r[5]].append((r[6], r[3]))
    for place in places.values():
        at = 0
        for offset, n in sorted(place):
            assert offset == at
            at += n
        assert at <= size
    return len(places)


def test_documents_survive_and_sequences_are_full(spark, encode):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéßñ0'") for _ in range(rng.randint(1, 7)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 30, 90])))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "  \n\t"), (None, "no number"), (None, None), (203, "<|endoftext|> é  x y I'LL don't ΣΑΣ"), (204, "a" * 3000), (205, "word " * 5000)] + rows[:20]
    n = check(rows, pack(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH, size=64), 64, encode.tokenizer)
    least = -(-sum(p[3] for p in pieces(rows, 64, encode.tokenizer)) // 64)
    assert n <= least + 1


def test_empty_table_and_clashing_columns(spark, encode):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    rows = [(1, "a b c"), (2, "d"), (2, "d")]
    extra = spark.createDataFrame([(*r, 5, 6, 7, "x") for r in rows], SCHEMA + ", length long, part long, offset long, piece string")
    assert check(rows, pack(extra, PATH), 4096, encode.tokenizer) == 1


def test_a_document_is_cut_only_where_it_is_longer(encode):
    ids = lambda text: [len(p) // 4 for p in token_pieces(text, encode, 8)]
    assert ids(b"a " * 7) == [8] and ids(b"a " * 8) == [8, 1] and ids(b"a " * 15) == [8, 8] and ids(b"") == [1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB '9é́s \u0085\x1c\nΣ<|>t.", max_size=80), st.integers(1, 12))
def test_chunks_do_not_change_ids(encode, text, chunk):
    before, packing.CHUNK = packing.CHUNK, chunk
    try:
        got = b"".join(token_pieces(text.encode(), encode, 4096))
    finally:
        packing.CHUNK = before
    assert np.frombuffer(got, "<u4").tolist() == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_memory_of_words_is_bounded(encode):
    own = WordEncoder(PATH)
    own.words, own.pieces = Memo(own._word, 8), Memo(own._piece, 4)
    texts = [f"w{i} x{i % 3} y{i}y {'z' * 70}{i}" for i in range(40)]
    assert [b"".join(token_pieces(t.encode(), own)) for t in texts] == [b"".join(token_pieces(t.encode(), encode)) for t in texts]
    assert len(own.words) <= 8 and len(own.words.before) <= 8 and len(own.pieces) <= 4 and all(len(w) <= 64 for w in own.words)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("'sStTrevmlLdD0 9\n"), st.characters(min_codepoint=33, max_codepoint=0x17F), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_those_of_the_tokenizer(encode, text):
    got = b"".join(token_pieces(text.encode(), encode, 4096))
    assert np.frombuffer(got, "<u4").tolist() == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_two_fit_replaces_the_smallest():
    left = np.zeros(11, np.int64)
    left[[6, 3, 2]] = 1, 1, 2
    assert dict(_fill(left, 10)) == {6: 1, 2: 2}  # greedy alone gives 6 and 3


def one_by_one(counts, size):
    """The plan without repeated patterns: a sequence at a time."""
    left, n = np.zeros(size + 1, np.int64), 0
    for length, k in counts.items():
        left[length] = k
    while left.any():
        for length, k in _fill(left, size).items():
            left[length] -= k
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 40), max_size=8))
def test_plan_places_every_piece(counts):
    plan, size = packing_plan(counts, 20), 20
    used = defaultdict(set)
    for length, k in counts.items():
        rows = plan[plan[:, 0] == length]
        for rank in range(k):
            _, first, uses, sequence, offset = rows[np.searchsorted(rows[:, 1], rank, "right") - 1]
            at = offset + (rank - first) % uses * length
            cells = set(range(at, at + length))
            bin_ = used[sequence + (rank - first) // uses]
            assert not bin_ & cells and at + length <= size
            bin_ |= cells
    assert all(c == set(range(len(c))) for c in used.values())
    assert len(used) == one_by_one(counts, size)
