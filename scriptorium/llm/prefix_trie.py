"""The trie of conversations that begin with the same turns, built level by level.

A turn is known by 120 bits of its SHA-256, so the texts are read once.  Each
round groups the live conversations by their node and their next turn, and a
child is named after its smallest member.  What would cost a round without
deciding anything is left out: a group whose members go on alike goes down to
the depth where they part at once, and a conversation that is alone leaves the
rounds, for the rest of its branch is its own.  So there are as many rounds as
branchings on a path, however long conversations are.  Then the rounds are gone
through backwards, each joined to what its children sum up to.

Conversations are rows of turns throughout and never lists: a conversation or
a node may hold a third of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, drop_cut

#: In place of a turn's digest where a conversation ends.
END = -1
#: A rebuilt conversation takes fewer turns than this from another one.
HEADS = 6
#: Depths of a block of the running sums.
BLOCK = 4096
#: Bytes of a piece of a list of identifiers.
PIECE = 1 << 13

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _digest(role: Column, text: Column) -> tuple[Column, Column]:
    """The first 30 hexadecimal digits of a turn's SHA-256 as two numbers."""
    hexed = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return tuple(F.conv(F.substring(hexed, at, 15), 16, 10).cast("long") for at in (1, 16))


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, chars) for each turn: its place in its conversation, its digest and its length.

    Turns go by number, null first, and equal numbers by digest.  The table is
    sorted as a whole, so a long conversation is sorted in several tasks; each
    counts on from what the tasks before it hold of the conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    a, b = _digest(role, text)
    turns = cut(conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", a.alias("a"), b.alias("b"), F.length(text).cast("long").alias("chars")))
    in_order = turns.orderBy("conv_id", F.col("turn").asc_nulls_first(), "a", "b").select("conv_id", "a", "b", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    in_order = cut(in_order)
    parts = in_order.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    return in_order.join(parts.select("conv_id", "part", "shift"), ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "a", "b", "chars")


def rebuilt(turns: DataFrame, family: int = 100) -> DataFrame:
    """(conv_id, pos, a, b, chars) of the rebuilt conversations, each with a last row for its end.

    Conversation c has the first h turns of conversation c - c % ``family``,
    then its own after its first h; h is the CRC-32 of its number modulo
    :data:`HEADS`.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    facts = sizes.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    facts = cut(facts.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    rest = turns.join(facts.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "chars")
    heads = turns.filter(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base").join(facts.select("conv_id", "base", "h"), "base").filter("pos < h").select("conv_id", "pos", "a", "b", "chars")
    end, none = F.lit(END).cast("long"), F.lit(0).cast("long")
    ends = facts.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("pos"), end.alias("a"), end.alias("b"), none.alias("chars"))
    return rest.unionByName(heads).unionByName(ends)


def _together(tables: list[DataFrame]) -> DataFrame:
    """Tables of :func:`cut` with the same columns as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._scratch_path for t in tables])


def _levels(rows: DataFrame) -> dict[str, DataFrame]:
    """What the rounds leave: their number, and for each round its ``tops``, shared ``turns`` below them, ``bottoms`` and ``kids``, and the ``ends`` of shared nodes."""
    root = rows.agg(F.min("conv_id").alias("node"), F.count_if(F.col("a") == END).alias("n"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("top"), F.lit(0).cast("long").alias("chars"))
    tops = cut(root.filter("n > 0").withColumn("round", F.lit(0)))
    first = tops.first()  # one row, or none of an empty table
    live, n_tops, number = rows.withColumn("node", F.lit(first and first["node"]).cast("long")), 1, 0
    turns, bottoms, kids, ends = [], [], [], []
    while n_tops:
        small, here = F.broadcast if n_tops <= BROADCAST_ROWS else (lambda df: df), F.lit(number).alias("round")
        parts = (F.min("a") != F.max("a")) | (F.min("b") != F.max("b")) | (F.min("a") == END)
        at = cut(live.groupBy("node", "pos").agg(F.max("chars").alias("chars"), parts.alias("parts")).select("node", "pos", "chars", "parts", here))
        low = cut(at.groupBy("node").agg(F.min(F.when(F.col("parts"), F.col("pos"))).alias("bottom")).select("node", "bottom", here))
        step = cut(live.join(small(low), "node").filter("pos = bottom").select("conv_id", "node", "bottom", "a", "b", "chars"))
        grown = cut(step.groupBy("node", "bottom", "a", "b").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.max("chars").alias("chars")).select("node", "bottom", "a", "b", "child", "n", "chars", here))
        for table, one in ((turns, at), (bottoms, low), (kids, grown), (ends, step)):
            table.append(one)
        shared = grown.filter((F.col("a") != END) & (F.col("n") > 1))
        n_tops, number = shared.count(), number + 1
        if n_tops:
            small = F.broadcast if n_tops <= BROADCAST_ROWS else (lambda df: df)
            go = step.join(small(shared.select("node", "a", "b", "child")), ["node", "a", "b"]).select("conv_id", "child", "bottom")
            went, live = live, cut(live.join(go, "conv_id").filter("pos > bottom").select("conv_id", "pos", live["a"], live["b"], live["chars"], F.col("child").alias("node")))
            drop_cut(went)
    grown = _together(kids)
    below = grown.filter((F.col("a") != END) & (F.col("n") > 1)).select(F.col("child").alias("node"), "n", F.col("node").alias("parent"), (F.col("bottom") + 1).alias("top"), "chars", (F.col("round") + 1).alias("round"))
    gone = _together(ends).filter(F.col("a") == END).select("conv_id", "node", F.col("bottom").alias("depth"))
    return {"rounds": number, "tops": tops.unionByName(below), "turns": _together(turns), "bottoms": _together(bottoms), "kids": grown, "ends": gone}


def _segments(levels: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(segments, chain): ways down without a branching, and their nodes below the top.

    Segments are round, node, parent, n, top, chars of the top's text, bottom,
    chain_chars, n_children and n_single.
    """
    keys, turn = ["round", "node"], F.col("a") != END
    chain = levels["turns"].join(levels["bottoms"], keys).filter("pos < bottom").select(*keys, (F.col("pos") + 1).alias("depth"), "chars")
    counts = levels["kids"].groupBy(*keys).agg(F.count_if(turn).alias("n_children"), F.count_if(turn & (F.col("n") == 1)).alias("n_single"))
    below = chain.groupBy(*keys).agg(F.sum("chars").alias("chain_chars"))
    return cut(levels["tops"].join(levels["bottoms"], keys).join(counts, keys).join(below, keys, "left").na.fill(0, ["chain_chars"])), chain


def _rolled_up(segments: DataFrame, rounds: int) -> DataFrame:
    """Segments with leaves and saved, those of the bottom's subtree, from the last round to the first."""
    done, below = [], None
    for number in range(rounds - 1, -1, -1):
        s = segments.filter(F.col("round") == number)
        if below is None:
            s = s.withColumn("_leaves", F.lit(0).cast("long")).withColumn("_saved", F.lit(0).cast("long"))
        else:
            sums = below.groupBy(F.col("parent").alias("node")).agg(F.sum("leaves").alias("_leaves"), F.sum(F.col("saved") + (F.col("n") - 1) * (F.col("chars") + F.col("chain_chars"))).alias("_saved"))
            s = s.join(sums, "node", "left").na.fill(0, ["_leaves", "_saved"])
        leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_single") + F.col("_leaves")).cast("long")
        below = cut(s.select(*segments.columns, leaves.alias("leaves"), F.col("_saved").alias("saved")))
        done.append(below)
    return _together(done)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, depth, conv_id) to pieces of each node's list (node, depth, first, ids)."""
    held: list = []

    def piece() -> pa.RecordBatch:
        node, depth, first, ids, _ = held
        held.clear()
        return pa.RecordBatch.from_pydict({"node": [node], "depth": [depth], "first": [first], "ids": [",".join(map(str, ids))]})

    for batch in batches:
        node, depth, conv = (c.to_numpy() for c in batch.columns)
        starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])]) if len(node) else []
        for i, j in zip(starts, [*starts[1:], len(node)]):
            for k in range(i, j, PIECE // 8):
                some = conv[k : min(j, k + PIECE // 8)].tolist()
                if held and (held[0] != node[i] or held[1] != depth[i] or held[4] + len(some) > PIECE // 8):
                    yield piece()
                if held:
                    held[3].extend(some)
                    held[4] += len(some)
                else:
                    held.extend([int(node[i]), int(depth[i]), some[0], some, len(some)])
    if held:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (node, depth, ends_sha256); a list goes through the hash piece by piece and is never held."""
    key, state = None, None
    for batch in batches:
        rows = []
        for node, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if (node, depth) != key:
                if key:
                    rows.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["node", "depth", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_pydict({"node": [key[0]], "depth": [key[1]], "ends_sha256": [state.hexdigest()]})


def list_hashes(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of rows (conv_id, node, depth): the hash of a node's identifiers in numerical order, joined by commas.

    Lists are put together in pieces where they are sorted, over all tasks, so
    what meets in one task of a large node is a thousandth of its rows.
    """
    order = ["node", "depth", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, "node long, depth long, first long, ids string")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_hashes, "node long, depth long, ends_sha256 string")


def _suffix_sums(rows: DataFrame) -> DataFrame:
    """``rows`` (round, node, depth, chars) with ``after``, the chars from this depth on, in two levels."""
    keys = ["round", "node"]
    rows = rows.withColumn("_block", F.floor(F.col("depth") / BLOCK))
    sums = rows.groupBy(*keys, "_block").agg(F.sum("chars").alias("_sum"))
    later = Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    sums = sums.withColumn("_later", F.coalesce(F.sum("_sum").over(later), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_block").orderBy("depth").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.join(sums, [*keys, "_block"]).withColumn("after", F.sum("chars").over(inside) + F.col("_later")).drop("_block", "_later")


def prefix_trie(conversations: DataFrame, family: int = 100) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: :data:`NODE`.

    ``conversations`` has conv_id, turn, role and text; other columns are not
    read.  Null roles and texts are empty.  Rows without a conv_id belong to no
    conversation and are left out.  Repeated rows are turns like any other.
    An empty table has no root and gives no row.
    """
    rows = cut(rebuilt(cut(positions(conversations)), family))
    levels = _levels(rows)
    segments, chain = _segments(levels)
    sums = _rolled_up(segments, levels["rounds"])
    hashes = list_hashes(levels["ends"])
    singles = levels["kids"].filter((F.col("a") != END) & (F.col("n") == 1)).select(F.col("child").alias("conv_id"), F.col("node").alias("parent"), (F.col("bottom") + 1).alias("top"))
    chain = _suffix_sums(chain).join(sums.drop("chars"), ["round", "node"]).select("node", "depth", F.col("node").alias("parent_conv_id"), "n", "bottom", "n_children", "leaves", (F.col("saved") + (F.col("n") - 1) * F.col("after")).alias("saved_tokens"))
    top = sums.select("node", F.col("top").alias("depth"), F.col("parent").alias("parent_conv_id"), "n", "bottom", "n_children", "leaves", (F.col("saved") + (F.col("n") - 1) * (F.col("chars") + F.col("chain_chars"))).alias("saved_tokens"))
    children = F.when(F.col("depth") == F.col("bottom"), F.col("n_children")).otherwise(1).cast("long")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    shared = top.unionByName(chain).join(hashes, ["node", "depth"], "left")
    shared = shared.select(F.col("node").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), children.alias("n_children"), F.col("leaves").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    one, last = F.lit(1).cast("long"), F.col("a") == END
    alone = rows.join(singles, "conv_id").filter("pos >= top").select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(empty).alias("ends_sha256"),
    )
    return shared.unionByName(alone).select(*NODE)
