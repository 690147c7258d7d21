"""Bounded evidence: windows around hits, byte budgets, fallbacks and unions.

Budgets are running sums over an archive's events and not loops: an event is
whole while the sum fits, cut where the sum crosses the budget, and left out
after that, for the first one that crosses uses up what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import head_bytes, tail_bytes, utf16_length
from ..model import EVIDENCE_BYTES, MAX_EVIDENCE

OFFSETS = (0, -1, 1)


def _archive(order: Column) -> Window:
    return Window.partitionBy("archive_id").orderBy(order)


def expand_window(anchors: DataFrame, events: DataFrame, limit: int = MAX_EVIDENCE) -> DataFrame:
    """(archive_id, sequence, event_id) of anchors and their neighbours.

    ``anchors`` has archive_id, sequence and rank.  Anchors count in rank
    order, each before its earlier and later neighbour; the first ``limit``
    distinct events stay.
    """
    if not 1 <= limit <= MAX_EVIDENCE:
        raise ValueError(f"a window has 1 to {MAX_EVIDENCE} events")
    offsets = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(i).alias("at")) for i, o in enumerate(OFFSETS)])
    near = anchors.select("archive_id", "rank", F.col("sequence").alias("_s"), F.explode(offsets).alias("o"))
    near = near.select("archive_id", (F.col("_s") + F.col("o.offset")).alias("sequence"), (F.col("rank") * len(OFFSETS) + F.col("o.at")).alias("priority"))
    near = near.groupBy("archive_id", "sequence").agg(F.min("priority").alias("priority"))
    found = near.join(events.select("archive_id", "sequence", "event_id"), ["archive_id", "sequence"])
    return found.withColumn("_n", F.row_number().over(_archive(F.col("priority")))).filter(F.col("_n") <= limit).select("archive_id", "sequence", "event_id")


def last_events(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of each archive."""
    return events.withColumn("_n", F.row_number().over(_archive(F.col("sequence").desc()))).filter(F.col("_n") <= n).drop("_n")


def head_budget(events: DataFrame, budget: int = EVIDENCE_BYTES, order: str = "sequence", excerpts: bool = False) -> DataFrame:
    """Events with state (full, truncated, omitted) and the bytes each may use.

    With ``excerpts`` the included text is added, cut at a code point.
    """
    size = F.octet_length("content").cast("long")
    w = _archive(F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("bytes", size).withColumn("before", F.coalesce(F.sum("bytes").over(w), F.lit(0)).cast("long"))
    room = F.lit(budget) - F.col("before")
    state = F.when(room <= 0, "omitted").when(F.col("bytes") <= room, "full").otherwise("truncated")
    e = e.withColumn("state", state).withColumn("allowed", F.greatest(F.lit(0), F.least(F.col("bytes"), room)).cast("long"))
    return e.withColumn("excerpt", F.when(F.col("state") != "omitted", head_bytes(F.col("content"), F.col("allowed")))) if excerpts else e


def budget_bytes(budgeted: DataFrame) -> DataFrame:
    """(archive_id, events, bytes) that a budget with excerpts includes."""
    return budgeted.groupBy("archive_id").agg(F.count_if(F.col("state") != "omitted").alias("events"), F.coalesce(F.sum(F.octet_length("excerpt")), F.lit(0)).cast("long").alias("bytes"))


def raw_tail(events: DataFrame, budget: int | str, excerpts: bool = False) -> DataFrame:
    """The newest events that fit a byte budget; the one that crosses it gives its tail.

    ``budget`` is a number or a column of ``events``.  An empty event still
    joins when the budget is exactly used up.
    """
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    w = _archive(F.col("sequence").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = events.withColumn("bytes", F.octet_length("content").cast("long")).withColumn("upto", F.sum("bytes").over(w))
    before = F.col("upto") - F.col("bytes")
    part = F.when(F.col("upto") <= limit, "full").when(before < limit, "tail")
    e = e.withColumn("part", part).filter(F.col("part").isNotNull()).withColumn("allowed", F.least(F.col("bytes"), limit - before).cast("long"))
    e = e.drop("upto")
    return e.withColumn("excerpt", tail_bytes(F.col("content"), F.col("allowed"))) if excerpts else e


def evidence_union(explicit: DataFrame, annotations: DataFrame, limit: int = MAX_EVIDENCE) -> DataFrame:
    """(archive_id, event_id, rank): chosen identifiers first, then annotated ones, distinct.

    Both have archive_id, event_id and pos.  Unknown identifiers use a place.
    """
    both = explicit.select("archive_id", "event_id", F.col("pos").cast("long").alias("p")).unionByName(annotations.select("archive_id", "event_id", (F.col("pos").cast("long") + (1 << 40)).alias("p")))
    first = both.groupBy("archive_id", "event_id").agg(F.min("p").alias("p"))
    return first.withColumn("rank", F.row_number().over(_archive(F.col("p")))).filter(F.col("rank") <= limit).select("archive_id", "event_id", "rank")


def event_block(event_id: Column, role: Column, content: Column) -> Column:
    return F.concat(F.lit("[event:"), event_id, F.lit(" role:"), role, F.lit("]\n"), content, F.lit("\n[/event:"), event_id, F.lit("]"))


def pack_prompt(events: DataFrame, max_chars: int, prefix_chars: int, order: str = "sequence") -> DataFrame:
    """The prefix of an archive's events whose blocks fit a prompt.

    Lengths are UTF-16 units; separators are not counted.  A first block that
    does not fit is cut and stands alone (``cut``).
    """
    room = max_chars - prefix_chars
    block = event_block(F.col("event_id"), F.col("role"), F.col("content"))
    e = events.withColumn("block_chars", utf16_length(block).cast("long"))
    w = _archive(F.col(order))
    e = e.withColumn("_upto", F.sum("block_chars").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.row_number().over(w))
    fits = (F.col("_upto") <= room) | (F.col("_n") == 1)
    e = e.filter(fits).withColumn("cut", (F.col("_n") == 1) & (F.col("block_chars") > room))
    return e.withColumn("rank", F.col("_n")).drop("_n", "_upto")
