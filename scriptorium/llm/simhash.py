"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  Two fingerprints that are near agree
within a small Hamming ball in at least one segment, so every fingerprint is
looked up at all points of that ball in each segment's table, and what is
found is verified by the distance of the complete fingerprints.

Tables are dealt out by (segment, half, value of that half): within radius 1
one half of a segment is equal, so the ball needs to be enumerated over the
other half only, and the lookups of a partition are binary searches in a
sorted array.  Equal fingerprints are one row (a class) from the start.  A cell
of many near fingerprints is walked breadth first, where what has been reached
is not compared again, so a task gives a spanning forest and never all pairs.

Near-duplicates by Jaccard similarity (:func:`near_duplicates`) are found by
fingerprints of the shingle sets in the same way and verified by the sets; what
fingerprints lose is found by prefixes of the sets.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized, slices, text_or_empty
from .components import connected_components

#: Rows of a table that a task looks at together; a key's rows are never parted.
BLOCK_ROWS = 100_000
#: The same for tables that carry shingle sets or their parities.
BLOCK_BYTES = 32 << 20
#: Shingles of other sets that a set is compared with together.
BLOCK_SHINGLES = 500_000
#: Leading bits of a shingle's hash that name its counter in the search by similarity.
COUNTER_BITS = 20
#: Parities of a shingle set: two sets differ in as many shingles as parities at least.
PARITIES = 4096
#: Fingerprints of shingle sets are looked up to this distance, up to which two segments lose none.
PRINT_DISTANCE = 3
#: A cell with more members than this is walked and not paired.
DENSE_CELL = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles, repeats included; A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    n = max(1, len(words) - k + 1)
    starts, stops = (ends - lens)[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprint(text: str, k: int = 3, lanes: int = 1) -> list[int]:
    """``lanes`` words of 64 bits; the first is the plain SimHash, the others re-mix the hashes."""
    h = shingle_hashes(text, k)
    if not len(h):
        return [0] * lanes
    out = [_majority(h)]
    for lane in range(1, lanes):
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F * (2 * lane + 1) % (1 << 64))
        x = (x ^ (x >> np.uint64(32))) * _MIX
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, lanes: int = 1) -> DataFrame:
    """(id, text_hash, f0..): one row for each row of ``docs``; a null text is empty, which gives zero."""

    def run(batches):
        names = ["id", "text_hash", *[f"f{i}" for i in range(lanes)]]
        for batch in batches:
            prints = [fingerprint(t.as_py(), k, lanes) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([_signed(p[i]) for p in prints], pa.int64()) for i in range(lanes)]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(docs, text_col)).alias("text_hash"), text_or_empty(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, " + ", ".join(f"f{i} long" for i in range(lanes)))


def _walk(prints: np.ndarray, rows: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """A spanning forest (row, row, distance) of the rows that are within ``limit`` of each other."""
    links, rest = [], rows
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            far = np.bitwise_count(prints[rest] ^ prints[x]).sum(1)
            near = far <= limit
            if near.any():
                found = rest[near]
                links.extend(zip([x] * len(found), found.tolist(), far[near].tolist()))
                queue.extend(found)
                rest = rest[~near]
    return links


def _forest(links: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The links of a minimum spanning forest: nearest first, none that closes a circle."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for a, b, _ in sorted(links, key=lambda e: e[2]):
        x, y = top(a), top(b)
        if x != y:
            up[y] = x
            out.append((a, b))
    return out


def block_links(key: np.ndarray, other: np.ndarray, prints: np.ndarray, half_bits: int, limits: tuple[int, ...]) -> list[tuple[int, int]]:
    """A minimum spanning forest of rows with equal ``key`` whose ``other`` halves differ in one bit at most.

    Rows are sorted by (key, other) and linked within the last of ``limits``
    bits.  The smaller limits matter for dense cells alone, which are walked
    once for each, so that near rows are linked by near pairs there too.
    """
    _, group = np.unique(key, return_inverse=True)
    cell = (group.astype(np.int64) << half_bits) | other
    values, first, count = np.unique(cell, return_index=True, return_counts=True)
    dense = count > DENSE_CELL
    links: list[tuple[int, int, int]] = []
    balls = [0, *[1 << i for i in range(half_bits)]]
    for c in np.flatnonzero(dense):
        at = np.searchsorted(values, values[c] ^ np.array(balls))
        at = np.unique(at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == values[c] ^ np.array(balls))])
        rows = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in at])
        for limit in limits:
            links += _walk(prints, rows, limit)
    for mask in balls:
        there = values ^ mask
        at = np.minimum(np.searchsorted(values, there), len(values) - 1)
        ok = (values[at] == there) & ~dense & ~dense[at] & ((at > np.arange(len(values))) | (mask == 0) & (count > 1))
        mine, theirs = np.flatnonzero(ok), at[ok]
        # all members of one cell against all of the other
        size = count[mine] * count[theirs]
        for lo in range(0, len(mine), 50_000):
            m, t, s = mine[lo : lo + 50_000], theirs[lo : lo + 50_000], size[lo : lo + 50_000]
            offset = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            a = np.repeat(first[m], s) + offset // np.repeat(count[t], s)
            b = np.repeat(first[t], s) + offset % np.repeat(count[t], s)
            if mask == 0:
                a, b = a[a < b], b[a < b]
            far = np.bitwise_count(prints[a] ^ prints[b]).sum(1)
            near = far <= limits[-1]
            links.extend(zip(a[near].tolist(), b[near].tolist(), far[near].tolist()))
    return _forest(links)


def segment_links(classes: DataFrame, lanes: int, segments: int, segment_bits: int, limits: tuple[int, ...]) -> DataFrame:
    """(a, b): links between nodes of ``classes`` (node, f0..), a spanning forest for each key of a table.

    No connection is lost where the last limit is below ``2 * segments`` and
    the segments cover all bits, for then one segment differs in one bit at
    most; beyond that, a link is found if any segment does.
    """
    half = segment_bits // 2
    low = (1 << half) - 1

    def segment(i: int) -> Column:
        at, out = i * segment_bits, None
        lane, shift = at // 64, at % 64
        out = F.shiftrightunsigned(F.col(f"f{lane}"), shift)
        if shift + segment_bits > 64:
            out = out.bitwiseOR(F.shiftleft(F.col(f"f{lane + 1}"), 64 - shift))
        return out

    def entry(i: int, which: int) -> Column:
        a, b = segment(i).bitwiseAND(F.lit(low).cast("long")), F.shiftrightunsigned(segment(i), half).bitwiseAND(F.lit(low).cast("long"))
        mine, other = (a, b) if which == 0 else (b, a)
        return F.struct((F.lit((2 * i + which) << 32).cast("long") + mine).alias("key"), other.alias("other"))

    entries = classes.select("node", *[f"f{i}" for i in range(lanes)], F.explode(F.array(*[entry(i, w) for i in range(segments) for w in (0, 1)])).alias("e"))
    entries = entries.select("e.key", "e.other", "node", *[f"f{i}" for i in range(lanes)])

    def run(batches):
        held, rows = [], 0

        def links_of(table: pa.Table):
            prints = np.stack([table.column(f"f{i}").to_numpy() for i in range(lanes)], 1).view(np.uint64)
            pairs = block_links(table.column("key").to_numpy(), table.column("other").to_numpy(), prints, half, limits)
            if pairs:
                node = table.column("node").to_numpy()
                ab = node[np.array(pairs, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if whole:
                    yield from links_of(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                rows -= whole
        if held:
            yield from links_of(pa.Table.from_batches(held))

    return entries.repartition("key").sortWithinPartitions("key", "other").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, lanes: int = 1, segments: int = 2, segment_bits: int = 32, max_distance: int = 2) -> DataFrame:
    """(id, text_hash, f0.., class_size, component_id) for each row of ``docs``.

    ``component_id`` is the smallest identifier reachable over links of at most
    ``max_distance`` differing bits.  Rows with a null identifier take part and
    get the smallest other identifier, null if there is none.  Repeated rows
    are linked to themselves.  A null text is empty; empty texts have the
    fingerprint zero and are linked like any other.  Empty table, empty result.
    Other columns of ``docs`` are not read.
    """
    f = [f"f{i}" for i in range(lanes)]
    prints = cut(fingerprints(docs, id_col, text_col, k, lanes))
    classes = cut(_classes(prints, f))
    links = segment_links(classes, lanes, segments, segment_bits, (max_distance,))
    return _component_rows(prints, classes, links, f)


def _classes(prints: DataFrame, f: list[str]) -> DataFrame:
    """(f0.., first_id, first_hash, class_size, node): one row for each fingerprint."""
    node = F.col("f0") if len(f) == 1 else F.xxhash64(*f)
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "text_hash"))
    c = prints.groupBy(*f).agg(first.alias("first"), F.count("*").alias("class_size"))
    return c.select(*f, F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "class_size", node.alias("node"))


def _component_rows(prints: DataFrame, classes: DataFrame, links: DataFrame, f: list[str]) -> DataFrame:
    roots = connected_components(links)
    rooted = classes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_r")
    member = cut(rooted.join(first, F.col("root") == F.col("_r")).select(*[F.col(c).alias(f"_{c}") for c in f], "class_size", "component_id"))
    return prints.join(member, [F.col(c) == F.col(f"_{c}") for c in f], "left").select("id", "text_hash", *f, "class_size", "component_id")


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _parities(x: np.ndarray) -> bytes:
    return np.packbits((np.bincount((x % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).astype(bool)).tobytes()


def _differ_at_most(size: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles sets of these sizes and that similarity are not both in."""
    return (1 - similarity) / (1 + similarity) * (size + other) + 1e-6


def _set_rows(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, text_hash, f0, size, bits, print) for each row of ``docs``, f0 a hash of its shingle set; and rows (part, counts).

    ``print`` is the set's SimHash; ``bits`` are the parities of the set's members, dealt by their last bits.

    The rows of parts are each task's number of sets by counter, packed, in 16 parts.
    """

    def run(batches):
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), k)) for t in batch.column(2)]
            counts += np.bincount(_counter(np.concatenate(sets)), minlength=len(counts)).astype(np.uint32)
            f0 = pa.array([_signed(xxhash.xxh3_64_intdigest(x.tobytes())) for x in sets], pa.int64())
            n, size = len(sets), pa.array([len(x) for x in sets], pa.int32())
            bits = pa.array([_parities(x) for x in sets], pa.binary())
            prints = pa.array([_signed(_majority(x)) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), f0, size, bits, prints, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            packed = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, 16)]
            yield pa.RecordBatch.from_arrays([pa.nulls(16, pa.int64())] * 3 + [pa.nulls(16, pa.int32()), pa.nulls(16, pa.binary()), pa.nulls(16, pa.int64()), pa.array(range(16), pa.int32()), pa.array(packed, pa.binary())], names=names)

    names = ["id", "text_hash", "f0", "size", "bits", "print", "part", "counts"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(docs, text_col)).alias("text_hash"), text_or_empty(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, f0 long, size int, bits binary, print long, part int, counts binary")


def _levels(counted: DataFrame) -> np.ndarray:
    """How common a counter's shingles are, in steps of an eighth of a doubling."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
                total[part] = total.get(part, 0) + c.astype(np.int64)
        if total:
            level = [np.minimum(np.round(8 * np.log2(1 + c)), 255).astype(np.uint8).tobytes() for c in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(level, pa.binary())], names=["part", "level"])

    out = np.zeros((16, (1 << COUNTER_BITS) // 16), np.uint8)
    # sixteen rows of 64 KB, whatever the size of the input
    for r in counted.repartition("part").mapInArrow(run, "part int, level binary").collect():
        out[r.part] = np.frombuffer(r.level, np.uint8)
    return out.reshape(-1)


def prefix_length(n: int, similarity: float) -> int:
    """Sets of that similarity share one of so many first members of a set of n, in any order common to all sets."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _prefix_cells(docs: DataFrame, levels: np.ndarray, id_col: str, text_col: str, k: int, similarity: float) -> DataFrame:
    """(shingle, node, hub, members): the sets with a shingle in their prefix, where they are two at least.

    ``hub`` is the smallest node of the shingle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def prefixes(batches):
        level = shared.value
        for batch in slices(batches):
            nodes, parts = [], []
            for t in batch.column(0):
                x = np.unique(shingle_hashes(t.as_py(), k))
                nodes.append(_signed(xxhash.xxh3_64_intdigest(x.tobytes())))
                parts.append(x[np.argsort(level[_counter(x)], kind="stable")[: prefix_length(len(x), similarity)]])
            shingles = np.concatenate(parts).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(np.repeat(np.array(nodes, np.int64), list(map(len, parts))))], names=["shingle", "node"])

    def cells(batches):
        for table in _whole_keys(batches, "shingle"):
            shingle, node = table.column("shingle").to_numpy(), table.column("node").to_numpy()
            new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])])
            shingle, node = shingle[new], node[new]
            _, first, group, count = np.unique(shingle, return_index=True, return_inverse=True, return_counts=True)
            hub, members = node[first][group], count[group]
            several = members > 1
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in (shingle, node, hub, members.astype(np.int64))], names=["shingle", "node", "hub", "members"])

    rows = docs.select(text_or_empty(docs, text_col).alias("text")).mapInArrow(prefixes, "shingle long, node long")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(cells, "shingle long, node long, hub long, members long")


def _whole_keys(batches, key: str):
    """Tables of about BLOCK_ROWS rows of batches sorted by ``key``, whose rows are never parted."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS or sum(b.nbytes for b in held) >= BLOCK_BYTES:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield table.slice(0, whole)
            held = table.slice(whole).to_batches()
            rows -= whole
    if rows:
        yield pa.Table.from_batches(held)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, shingles) of the documents that stand for the ``wanted`` classes (node, first_id, first_hash)."""

    def run(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), k)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    text = text_or_empty(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    rows = rows.join(wanted, F.col("_id").eqNullSafe(F.col("first_id")) & (F.col("_hash") == F.col("first_hash"))).select("node", "text")
    return rows.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def similar_links(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links whose two shingle sets have at least that Jaccard similarity."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return links.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def cell_links(labels: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (row, row) that join all rows of similar sets, beyond what equal ``labels`` join already.

    Every row is compared with all later rows that nothing joins to it yet.
    """
    label = np.unique(labels, return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    members, ends = np.concatenate(sets), np.cumsum(sizes)
    out = []
    for i in range(len(sets) - 1):
        far = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i]) - 1e-9))
        step = min(1000, 1 + BLOCK_SHINGLES // max(sizes[i], 1))
        for lo in range(0, len(far), step):
            some = far[lo : lo + step]
            theirs = np.concatenate([members[ends[j] - sizes[j] : ends[j]] for j in some])
            at = np.minimum(np.searchsorted(sets[i], theirs), sizes[i] - 1)
            both = np.add.reduceat((sets[i][at] == theirs).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for j in some[both >= similarity * (sizes[i] + sizes[some] - both)].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def _possible_links(links: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The links that the parities of ``known`` (node, size, bits) do not rule out."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m, n = (batch.column(i).to_numpy() for i in (2, 4))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, PARITIES // 64) for i in (3, 5))
            keep = pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= _differ_at_most(m, n, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = known.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("bits").alias("x"))
    right = known.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("bits").alias("y"))
    sizes = links.join(left, "a").join(right, "b").filter(F.least("m", "n") >= F.greatest("m", "n") * F.lit(similarity) - F.lit(1e-9))
    return sizes.select("a", "b", "m", "x", "n", "y").mapInArrow(run, "a long, b long")


def _open_cells(cells: DataFrame, links: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(cell, node, label): the sets of ``cells`` that may be similar to one which ``links`` do not join to them.

    Cells of the same such sets are one.
    """
    roots = connected_components(links).withColumnRenamed("node", "_n")
    labelled = cut(cells.filter("members > 2").join(roots, F.col("node") == F.col("_n"), "left").select("shingle", "node", F.coalesce("root", "node").alias("label")))
    parted = labelled.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("shingle")
    rows = labelled.join(parted, "shingle", "left_semi").join(known, "node").select("shingle", "node", "label", "size", "bits")

    def run(batches):
        for table in _whole_keys(batches, "shingle"):
            node, label, size = (table.column(c).to_numpy() for c in ("node", "label", "size"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, PARITIES // 64)
            _, first, count = np.unique(table.column("shingle").to_numpy(), return_index=True, return_counts=True)
            for lo, n in zip(first.tolist(), count.tolist()):
                near = np.zeros(n, bool)
                for i in range(n - 1):
                    m, other = size[lo + i], size[lo + i + 1 : lo + n]
                    far = i + 1 + np.flatnonzero((label[lo + i + 1 : lo + n] != label[lo + i]) & (np.minimum(m, other) >= similarity * np.maximum(m, other) - 1e-9))
                    for at in range(0, len(far), 10_000):
                        some = far[at : at + 10_000]
                        ok = some[np.bitwise_count(bits[lo + some] ^ bits[lo + i]).sum(1, dtype=np.int64) <= _differ_at_most(m, size[lo + some], similarity)]
                        near[ok] = True
                        near[i] |= len(ok) > 0
                if near.any():
                    some = lo + np.flatnonzero(near)
                    cell = _signed(xxhash.xxh3_64_intdigest(node[some].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), cell)), pa.array(node[some]), pa.array(label[some])], names=["cell", "node", "label"])

    return rows.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(run, "cell long, node long, label long").distinct()


def _open_cell_links(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the links within ``cells`` (cell, node, label), beyond what equal labels join already."""

    def run(batches):
        for table in _whole_keys(batches, "cell"):
            node, label, held = table.column("node").to_numpy(), table.column("label").to_numpy(), table.column("shingles")
            _, first, count = np.unique(table.column("cell").to_numpy(), return_index=True, return_counts=True)
            for lo, n in zip(first.tolist(), count.tolist()):
                members = [np.frombuffer(x.as_py(), np.uint64) for x in held.slice(lo, n)]
                found = [(node[lo + i], node[lo + j]) for i, j in cell_links(label[lo : lo + n], members, similarity)]
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = cells.join(sets, "node").select("cell", "node", "label", "shingles")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def _print_links(rows: DataFrame) -> DataFrame:
    """(a, b): candidates among the sets of ``rows`` (f0, print) by multi-index hashing of their fingerprints.

    Sets of one fingerprint are candidates of the smallest of them; two
    fingerprints are those of their smallest sets.
    """
    sets = rows.select("f0", "print").distinct()
    prints = cut(sets.groupBy(F.col("print").alias("f0")).agg(F.min("f0").alias("first")).withColumn("node", F.col("f0")))
    same = sets.join(prints.select(F.col("f0").alias("_p"), "first"), F.col("print") == F.col("_p")).select(F.col("first").alias("a"), F.col("f0").alias("b"))
    first = lambda c: prints.select(F.col("node").alias(f"_{c}"), F.col("first").alias(f"f{c}"))
    near = segment_links(prints, 1, 2, 32, (PRINT_DISTANCE,)).distinct()
    near = near.join(first("a"), F.col("a") == F.col("_a")).join(first("b"), F.col("b") == F.col("_b")).select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    return same.filter("a <> b").unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, k: int = 5) -> DataFrame:
    """(id, text_hash, component_id) by the similarity of k-word shingle sets.

    Candidates are first the sets whose SimHash fingerprints multi-index
    hashing finds near; those whose sets are similar are joined.  Fingerprints
    lose pairs, so an exact way for the rest follows.
    Two sets of a Jaccard similarity share one of the first members of both,
    in any order that is the same for all sets (prefix filtering), so no pair
    is lost.  Rare shingles come first; how common they are is counted
    roughly, which the result does not depend on.  Of the sets that share a
    prefix shingle each is compared with the smallest first, and those that
    this does not join are compared with each other, so a large group of near
    copies never gives all its pairs.  Parities of the sets, which bound from
    below how much they differ, spare most comparisons of the sets themselves.  Equal sets are one class.  Rows are
    treated as by :func:`simhash_components`.
    """
    rows = cut(_set_rows(docs, id_col, text_col, k))
    levels = _levels(rows.filter("part is not null").select("part", "counts"))
    prints = rows.filter("part is null").select("id", "text_hash", "f0")
    classes = cut(_classes(prints, ["f0"]))
    cells = cut(_prefix_cells(docs, levels, id_col, text_col, k, similarity))
    near = cut(_print_links(rows.filter("part is null")))
    wanted = cells.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    known = rows.filter("part is null").select(F.col("f0").alias("node"), "size", "bits").join(wanted, "node", "left_semi")
    known = cut(known.dropDuplicates(["node"]))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted, _ = sized(classes.join(nodes.distinct(), "node", "left_semi").select("node", "first_id", "first_hash"))
        return cut(_shingle_sets(docs, wanted, id_col, text_col, k))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(_possible_links(pairs, known, similarity))
        return cut(similar_links(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), similarity))

    by_print = verified(near)
    # the rest: what fingerprints have joined with the smallest set of a shingle is not compared with it again
    roots = cut(connected_components(by_print))
    root = lambda c: roots.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"r{c}"))
    stars = cells.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(root("a"), F.col("a") == F.col("_a"), "left").join(root("b"), F.col("b") == F.col("_b"), "left")
    stars = stars.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    links = cut(by_print.unionByName(verified(stars)))
    rest = cut(_open_cells(cells, links, known, similarity))
    links = links.unionByName(cut(_open_cell_links(rest, sets_of(rest.select("node")), similarity)))
    return _component_rows(prints, classes, links, ["f0"]).select("id", "text_hash", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: those with the smallest identifier of their group.

    A row without identifier stays.
    """
    groups = near_duplicates(docs, id_col, text_col, similarity, k)
    gone, _ = sized(groups.filter("id <> component_id").select(F.col("id").alias("__near_id"), F.col("text_hash").alias("__near_hash")).distinct())
    return docs.join(gone, (docs[id_col].cast("long") == F.col("__near_id")) & (F.xxhash64(text_or_empty(docs, text_col)) == F.col("__near_hash")), "left_anti")
