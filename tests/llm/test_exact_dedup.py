from collections import defaultdict
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from scriptorium.llm.exact_dedup import PatriciaTrie, exact_dedup, exact_groups, hash_bits, owners_of_copies

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "ab"), (6, "abc"), (6, "abc"), (None, "abc"), (None, "lone null"), (7, "x" * 300_000), (8, "x" * 300_000), (9, "x" * 299_999 + "y"), (10, "Ä"), (11, "ä")]
SCHEMA = "doc_id long, text string, kept string, keep_id string, content string, owner string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "d", "e", "f") for r in rows], SCHEMA)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.none(), st.integers(0, 50)))), st.booleans())
def test_trie_holds_owners(rows, largest):
    trie = PatriciaTrie(largest)
    want = defaultdict(list)
    for key, owner in rows:
        trie.insert(key, owner)
        want[key].append(owner)
    pick = max if largest else min
    assert {k: (o, c) for k, o, c, _ in trie.terminals()} == {k: (pick((x for x in v if x is not None), default=None), len(v)) for k, v in want.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6)))
def test_spilled_subtrees_hold_what_the_trie_lacks(keys):
    trie, out = PatriciaTrie(), []
    for key in keys:
        trie.insert(key, 0)
    while trie.label_bytes:
        first, terminals = trie.spill_largest()
        assert terminals and all(t[0][:1] == first for t in terminals)
        out += terminals
    out += trie.terminals()
    assert sorted(t[0] for t in out) == sorted(set(keys)) and sum(t[2] for t in out) == len(keys)


def test_keys_of_a_partition_share_inner_nodes():
    trie = PatriciaTrie()
    for key in (b"template one", b"template two", b"template two", b"temple"):
        trie.insert(key, 1)
    (label, inner), = trie.root[0].values()
    assert label == b"templ" and inner[2] == 0 and len(inner[0]) == 2 and trie.keys == 3
    assert trie.label_bytes == len(b"templ" + b"ate " + b"one" + b"two" + b"e")


def test_subtrees_spilled_after_the_shuffle_are_merged(spark):
    # one length class, one hash range and a common first byte, so tries spill until the hash parts them
    texts = [f"shared beginning {i:04}" for i in range(60)] * 2
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    keyed = rows.select("id", F.xxhash64("text").alias("content_hash"), F.col("text").cast("binary").alias("content"))
    got = owners_of_copies(keyed, False, 0, 200).collect()
    assert sorted((r.keep_id, r.group_size) for r in got) == [(i, 2) for i in range(60)]
    assert hash_bits(0) == 0 and hash_bits(1 << 20) == 11 and hash_bits(10**15) == 24


def test_groups_against_brute_force(spark):
    by = defaultdict(list)
    for d, t in ROWS:
        by[t or ""].append(d)
    for keep, pick in (("largest", max), ("smallest", min)):
        for budget in (1 << 20, 0):  # 0: every batch spills
            got = exact_groups(frame(spark, ROWS), keep=keep, trie_bytes=budget).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
            want = []
            for d, t in ROWS:
                group = by[t or ""]
                owner = pick((x for x in group if x is not None), default=None)
                want.append((d, owner, len(group), d == owner, sha256((t or "").encode()).hexdigest()))
            assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_dedup_keeps_one_row_of_each_text(spark):
    got = exact_dedup(frame(spark, ROWS)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, "a"), (3, None), (5, "ab"), (6, "abc"), (None, "lone null"), (7, "x" * 300_000), (9, "x" * 299_999 + "y"), (10, "Ä"), (11, "ä")], key=str)
    assert got[0].owner == "f" and got[0].kept == "c"


def test_empty(spark):
    assert exact_groups(frame(spark, [])).collect() == [] and exact_dedup(frame(spark, [])).collect() == []
