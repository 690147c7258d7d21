"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, ``epochs`` times over.  A
document of over ``quantum`` words stands in the queue as several packets, as
fair queueing deals with long messages.  A packet's virtual finish time is the
source's words up to its end, divided by the source's target; all packets are
put in the order of their finish times, over all sources, and the mix is what
stands before the place where the running sum of their words reaches the
budget.  A document is taken as far as its packets are.

Only DataFrame functions are used, and nothing sorts a whole source or the
whole queue in one task.  Running sums go in two levels: a source's queue is
cut by the leading digits of the shuffle key, and the global order by slices
of virtual time, of which each holds about the same number of words, however
large one source is.  Sums of slices tell in which slice the budget ends; only
that one is sorted packet by packet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Hexadecimal digits of the shuffle key that name a bucket: 4096 per source.
BUCKET_DIGITS = 3
#: Slices of a unit of virtual time; the result does not depend on it.
SLICES = 1 << 14
#: Words of a packet: no source is further than that from its share of the order.
QUANTUM = 500


def word_count(c: Column) -> Column:
    """Words of a text: pieces between runs of white space, without the empty ones at both ends."""
    return F.size(F.array_remove(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Weights dealt to sources in code-point order, null last, repeating.

    This window and those of :func:`capped_targets` see one row for each source
    in one task, and never the documents: some millions of sources at most.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (at % len(weights) + 1).cast("int")).cast("double"))


def capped_targets(sources: DataFrame, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``target`` for rows of (source, source_size, weight).

    The budget is ``share`` of all sizes.  No target exceeds ``epochs`` times
    its source; what is over is shared again by weight until none is above.
    The fixed point fills sources in the order of cap over weight: a source is
    capped when its cap is at most its share of what the sources before it
    leave.  Empty sources have target 0.
    """
    every = Window.partitionBy()
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("fill", F.col("cap") / F.col("weight"))
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("capped", F.col("cap") * F.col("weight_left") <= (F.col("budget") - F.col("cap_before")) * F.col("weight"))
    left = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    # whole numbers until the division, so the double is the nearest to the fraction
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("budget") - left) * F.col("weight") / weight))
    return s.select("source", "source_size", "weight", "target")


def queued(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """``docs`` (identifier, source, size and any more columns) with ``source_size``, ``target`` and ``_before``.

    ``_before`` is how many words of its source stand before a document in the
    first round of its queue.  Rows with equal identifiers are ordered by size.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    by_source = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(by_source), F.lit(0)).alias("_offset"))
    facts = offsets.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    facts = facts.withColumnRenamed("source", "_source").withColumnRenamed("_bucket", "_b")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "size", F.col(id_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_inside", F.sum("size").over(inside))
    out = rows.join(facts, (F.col("source").eqNullSafe(F.col("_source"))) & (F.col("_bucket") == F.col("_b")))
    return out.withColumn("_before", F.col("_offset") + F.col("_inside") - F.col("size")).drop("_key", "_bucket", "_b", "_source", "_offset", "_inside")


def packets_of(epochs: int, quantum: int) -> Column:
    """The packets of a queued row: their ``words``, ``end`` in the source's queue and virtual ``finish``."""
    each = F.ceil(F.col("size") / F.lit(quantum))

    def packet(i: Column) -> Column:
        part = i % each
        start = part * quantum
        stop = F.least(start + F.lit(quantum), F.col("size"))
        end = F.col("_before") + F.floor(i / each).cast("long") * F.col("source_size") + stop
        return F.struct((stop - start).alias("words"), end.alias("end"), (end / F.col("target")).alias("finish"))

    return F.transform(F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), each * epochs - 1)).otherwise(F.array().cast("array<bigint>")), packet)


def fair_schedule(queue: DataFrame, budget: int, epochs: int = 2, quantum: int = QUANTUM, slices: int = SLICES) -> DataFrame:
    """Rows of :func:`queued` with ``finish``, that of the first copy, and ``taken``, the words the mix takes of all copies.

    Packets are ordered by finish time, source and place in the source's queue,
    and taken until the budget is spent; the packet in which it ends is taken
    in part.  Rows without words take 0 and have no place in the order.
    """
    packets = queue.select("source", F.explode(packets_of(epochs, quantum)).alias("p")).select("source", "p.*")
    packets = packets.withColumn("_slice", F.floor(F.col("finish") * slices))
    sums = packets.groupBy("_slice").agg(F.sum("words").alias("_sum"))
    upto = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each slice of virtual time that is in use
    full = sums.withColumn("_upto", F.sum("_sum").over(upto)).filter(F.col("_upto") >= budget).orderBy("_slice").first() if budget > 0 else None
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("end")]
    last, part = None, 0
    if full:
        inside = packets.filter(F.col("_slice") == full["_slice"])
        running = F.sum("words").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(full["_upto"] - full["_sum"])
        last = inside.withColumn("_upto", running).filter(F.col("_upto") >= budget).orderBy(*order).first()
        part = last["words"] - (last["_upto"] - budget)

    def served(p: Column) -> Column:
        if budget <= 0:
            return F.lit(0).cast("long")
        if last is None:  # the budget outlasts the queue
            return p["words"]
        mine, theirs, finish = F.col("source"), F.lit(last["source"]).cast("string"), F.lit(last["finish"])
        earlier = (mine < theirs) if last["source"] is not None else mine.isNotNull()
        whole = (p["finish"] < finish) | (p["finish"] == finish) & (F.coalesce(earlier, F.lit(False)) | mine.eqNullSafe(theirs) & (p["end"] < last["end"]))
        at_end = mine.eqNullSafe(theirs) & (p["end"] == last["end"])
        return F.when(whole, p["words"]).when(at_end, F.lit(part).cast("long")).otherwise(F.lit(0).cast("long"))

    taken = F.aggregate(packets_of(epochs, quantum), F.lit(0).cast("long"), lambda sum_, p: sum_ + served(p))
    finish = F.when(F.col("size") > 0, (F.col("_before") + F.col("size")) / F.col("target"))
    return queue.withColumn("finish", finish).withColumn("taken", taken).drop("_before")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 7, quantum: int = QUANTUM) -> DataFrame:
    """Identifier, source, size, source_size, target, finish and taken for each row, in the mix's order.

    A null text has size 0 and a null source is a source of its own, last in
    order.  Repeated rows are rows like any other.  An empty table, or one of
    empty texts, takes nothing.
    """
    # the texts are read once; what follows works on sizes
    sized = cut(docs.select(F.col(id_col), F.col("source"), word_count(F.col(text_col)).alias("size")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = capped_targets(cycled_weights(sources, weights), share, epochs)
    queue = cut(queued(sized, targets, id_col, seed))
    total = sized.agg(F.sum("size")).first()[0] or 0
    return fair_schedule(queue, int(total * share), epochs, quantum).orderBy(F.col("finish").asc_nulls_last(), F.col(id_col))
