"""Exact deduplication with Patricia-trie owners.

Texts are dealt out by length class (bits of the byte length) and range of the
content hash.  Each such partition is one compressed radix trie of the full
byte strings, whose terminal nodes hold the owner (smallest or largest
identifier) and the number of rows.

The tries run twice.  First on the map side, over each input split, so that a
group of copies that holds a third of all rows leaves a split as one row.  Then
after the shuffle, where the rows of a partition come together.  A trie that
outgrows its memory spills its largest subtree below the root: on the map side
its terminals are passed on early as partial owners; after the shuffle they are
set aside, with all later texts of that subtree, and the next round deals them
to partitions of a sixteenth of the hash range, until nothing is set aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized, slices, text_or_empty

#: Bytes of edge labels that the tries of a map-side task, and one trie after the shuffle, hold before they spill subtrees.
TRIE_BYTES = 48 << 20


class PatriciaTrie:
    """A radix trie over byte strings with path compression.

    A node is ``[edges, owner, count, mark]`` and an edge ``[label, node]``,
    kept by the label's first byte; ``count`` is 0 for inner nodes and ``mark``
    is what was given with the key.
    """

    def __init__(self, prefer_largest: bool = False):
        self.root = [{}, None, 0, 0]
        self.prefer_largest = prefer_largest
        self.label_bytes = self.keys = 0

    def insert(self, key: bytes, owner: int | None, count: int = 1, mark: int = 0) -> None:
        node, at = self.root, 0
        while at < len(key):
            edge = node[0].get(key[at])
            if edge is None:
                leaf = [{}, None, 0, mark]
                node[0][key[at]] = [key[at:], leaf]
                self.label_bytes += len(key) - at
                node = leaf
                break
            label, child = edge
            if not key.startswith(label, at):
                child = self._split(edge, _shared(label, key, at))
                label = edge[0]
            node, at = child, at + len(label)
        if node[2] == 0:
            self.keys += 1
            node[1], node[3] = owner, mark
        elif owner is not None:
            node[1] = owner if node[1] is None else max(node[1], owner) if self.prefer_largest else min(node[1], owner)
        node[2] += count

    @staticmethod
    def _split(edge: list, n: int) -> list:
        label, child = edge
        middle = [{label[n]: [label[n:], child]}, None, 0, 0]
        edge[0], edge[1] = label[:n], middle
        return middle

    @staticmethod
    def _below(prefix: bytes, node: list) -> Iterator[tuple[bytes, int | None, int, int]]:
        stack = [(prefix, node)]
        while stack:
            prefix, (edges, owner, count, mark) = stack.pop()
            if count:
                yield prefix, owner, count, mark
            stack.extend((prefix + label, child) for label, child in edges.values())

    @staticmethod
    def _size(edge: list) -> int:
        size, stack = 0, [edge]
        while stack:
            label, (edges, *_) = stack.pop()
            size += len(label)
            stack.extend(edges.values())
        return size

    def terminals(self) -> Iterator[tuple[bytes, int | None, int, int]]:
        """(key, owner, count, mark) of every key."""
        yield from self._below(b"", self.root)

    def spill_largest(self) -> tuple[bytes, list[tuple[bytes, int | None, int, int]]]:
        """Takes the largest subtree below the root out: the first byte of its keys, and its terminals."""
        edges = self.root[0]
        first = max(edges, key=lambda b: self._size(edges[b]))
        edge = edges.pop(first)
        self.label_bytes -= self._size(edge)
        out = list(self._below(*edge))
        self.keys -= len(out)
        return bytes([first]), out


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by bisection."""
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


_SPILL = "length_class int, hash_range long, n_bytes long, content_hash long, content binary, owner long, copies long"
_MERGED = "text_sha256 string, " + _SPILL
_PARTIAL = pa.schema([("length_class", pa.int32()), ("hash_range", pa.int64()), ("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("content", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])
_OWNERS = pa.schema([("text_sha256", pa.string()), *_PARTIAL])


def _batches(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of at most 5000 rows or about 8 MB of content."""
    out, size, at = [], 0, schema.get_field_index("content")

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    for row in rows:
        out.append(row)
        size += len(row[at] or b"")
        if size > 8 << 20 or len(out) >= 5000:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def hash_bits(rows: int) -> int:
    """Leading bits of the content hash that name a range, so that a trie holds some hundred texts."""
    return min(24, max(0, math.ceil(math.log2(max(rows, 1) / 512))))


def _range(content_hash: int, bits: int) -> int:
    return (content_hash & (1 << 64) - 1) >> (64 - bits) if bits else 0


def _map_tries(prefer_largest: bool, bits: int, budget: int):
    def run(batches):
        tries: dict[tuple[int, int], PatriciaTrie] = {}
        held = 0

        def rows(key, terminals):
            for content, owner, copies, h in terminals:
                yield *key, len(content), h, content, owner, copies

        def spill():
            nonlocal held
            while held > budget // 2:
                key = max(tries, key=lambda k: tries[k].label_bytes)
                before = tries[key].label_bytes
                yield from rows(key, tries[key].spill_largest()[1])
                held -= before - tries[key].label_bytes

        def given():
            nonlocal held
            for batch in slices(batches):
                for doc_id, h, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    key = len(content).bit_length(), _range(h, bits)
                    trie = tries.get(key)
                    if trie is None:
                        trie = tries[key] = PatriciaTrie(prefer_largest)
                    before = trie.label_bytes
                    trie.insert(content, doc_id, 1, h)
                    held += trie.label_bytes - before
                if held > budget:
                    yield from spill()
            for key, trie in tries.items():
                yield from rows(key, trie.terminals())

        yield from _batches(_PARTIAL, given())

    return run


def _reduce_tries(prefer_largest: bool, bits: int, budget: int):
    def run(batches):
        from hashlib import sha256

        def finished(trie):
            for content, owner, copies, _ in trie.terminals():
                if copies > 1:
                    yield sha256(content).hexdigest(), None, None, None, None, None, owner, copies

        def set_aside(content, owner, copies, h):
            return None, len(content).bit_length(), _range(h, min(bits + 4, 64)), len(content), h, content, owner, copies

        def merged():
            key, trie, aside = None, None, set()
            for batch in slices(batches):
                for length_class, hash_range, h, content, owner, copies in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))):
                    if key != (length_class, hash_range):
                        if trie is not None:
                            yield from finished(trie)
                        key, trie, aside = (length_class, hash_range), PatriciaTrie(prefer_largest), set()
                    if content[:1] in aside:
                        yield set_aside(content, owner, copies, h)
                        continue
                    trie.insert(content, owner, copies, h)
                    # a range of one hash cannot be parted further, and is one text but for collisions
                    while trie.label_bytes > budget and trie.keys > 1 and bits < 64:
                        first, terminals = trie.spill_largest()
                        aside.add(first)
                        yield from (set_aside(*t) for t in terminals)
            if trie is not None:
                yield from finished(trie)

        yield from _batches(_OWNERS, merged())

    return run


def owners_of_copies(keyed: DataFrame, largest: bool, bits: int, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(text_sha256, keep_id, group_size) of the texts of ``keyed`` (id, content_hash, content) that stand in several rows."""
    partial = keyed.mapInArrow(_map_tries(largest, bits, trie_bytes), _SPILL)
    found = None
    while True:
        dealt = partial.repartition("length_class", "hash_range").sortWithinPartitions("length_class", "hash_range")
        # groups of copies, and the contents that a trie had no room for
        merged = cut(dealt.mapInArrow(_reduce_tries(largest, bits, trie_bytes), _MERGED))
        part = merged.filter("text_sha256 is not null").select("text_sha256", F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"))
        found = part if found is None else found.unionByName(part)
        partial = merged.filter("text_sha256 is null").drop("text_sha256")
        if partial.isEmpty():
            return found
        bits = min(bits + 4, 64)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their bytes are.  A null text counts as empty; null
    identifiers own a group only if all its identifiers are null.  Rows that
    repeat an identifier and a text count each time in ``group_size`` and share
    the value of ``kept``.  An empty table gives an empty result.  All columns
    of ``docs`` stay, but for those with the four names above, which are
    replaced.
    """
    text = text_or_empty(docs, text_col)
    keyed = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("content_hash"), text.cast("binary").alias("content"))
    owners = owners_of_copies(keyed, keep == "largest", hash_bits(docs.count()), trie_bytes)
    owners = owners.select(F.col("text_sha256").alias("__trie_sha"), F.col("keep_id").alias("__trie_keep"), F.col("group_size").alias("__trie_size"))
    rows = docs.drop("keep_id", "group_size", "kept", "text_sha256").withColumn("text_sha256", F.sha2(text, 256))
    out = rows.join(owners, rows["text_sha256"] == owners["__trie_sha"], "left")
    return (
        out.withColumn("keep_id", F.when(F.col("__trie_size").isNull(), F.col(id_col).cast("long")).otherwise(F.col("__trie_keep")))
        .withColumn("group_size", F.coalesce("__trie_size", F.lit(1).cast("long")))
        .withColumn("kept", F.col(id_col).cast("long").eqNullSafe(F.col("keep_id")))
        .drop("__trie_sha", "__trie_keep", "__trie_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text.

    Of rows that repeat the identifier that stays, one remains.
    """
    groups = cut(exact_groups(docs.select(id_col, text_col), id_col, text_col, keep).select(F.col(id_col).alias("__trie_id"), F.col("text_sha256").alias("__trie_sha"), "kept", "group_size").filter("group_size > 1"))
    gone, _ = sized(groups.filter("not kept").select("__trie_id", "__trie_sha").distinct())
    twice, repeats = sized(groups.filter("kept").groupBy("__trie_id", "__trie_sha").count().filter("count > 1").drop("count"))

    def meets(df):
        return df[id_col].eqNullSafe(F.col("__trie_id")) & (F.sha2(text_or_empty(df, text_col), 256) == F.col("__trie_sha"))

    stay = docs.join(gone, meets(docs), "left_anti")
    if not repeats:
        return stay
    once = stay.join(twice, meets(stay), "left_semi").withColumn("__trie_sha", F.sha2(text_or_empty(stay, text_col), 256)).dropDuplicates(["__trie_sha"]).drop("__trie_sha")
    return stay.join(twice, meets(stay), "left_anti").unionByName(once)
