"""The event graph of each archive: nodes, timeline and manual edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..model import GRAPH_KINDS, MAX_MANUAL_EDGES
from .integrity import signed_differences
from .projection import inspect_events

GRAPH_SCHEMA = "scriptorium-graph/1"


def graph_nodes(events: DataFrame) -> DataFrame:
    return inspect_events(events)


def timeline_edges(events: DataFrame) -> DataFrame:
    """(archive_id, from_id, to_id, kind, sequence): each event to the next."""
    w = Window.partitionBy("archive_id").orderBy("sequence")
    e = events.select("archive_id", F.col("event_id").alias("from_id"), F.lead("event_id").over(w).alias("to_id"), F.lit("next").alias("kind"), "sequence")
    return e.filter(F.col("to_id").isNotNull())


def edge_places(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges with the sequence of both ends, null where an end is unknown."""
    at = events.select("archive_id", "event_id", "sequence")
    e = edges.join(at.withColumnsRenamed({"event_id": "from_id", "sequence": "from_sequence"}), ["archive_id", "from_id"], "left")
    return e.join(at.withColumnsRenamed({"event_id": "to_id", "sequence": "to_sequence"}), ["archive_id", "to_id"], "left")


def manual_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges with ``problem``: unknown end, kind, direction, repetition or excess; null if sound.

    ``rank`` is the canonical order: places of both ends, then kind.
    """
    e = edge_places(edges, events)
    same = Window.partitionBy("archive_id", "from_id", "to_id", "kind")
    total = Window.partitionBy("archive_id")
    e = e.withColumn("_same", F.count("*").over(same)).withColumn("_total", F.count("*").over(total))
    problem = (
        F.when(~F.coalesce(F.col("kind").isin(*GRAPH_KINDS), F.lit(False)), "kind")
        .when(F.col("from_sequence").isNull() | F.col("to_sequence").isNull(), "unknown event")
        .when(F.col("from_sequence") >= F.col("to_sequence"), "not forward")
        .when(F.col("_same") > 1, "repeated")
        .when(F.col("_total") > MAX_MANUAL_EDGES, "too many")
    )
    order = total.orderBy("from_sequence", "to_sequence", "kind")
    return e.withColumn("problem", problem).withColumn("rank", F.row_number().over(order)).select("archive_id", "from_id", "to_id", "kind", "from_sequence", "to_sequence", "problem", "rank")


def build_graph(events: DataFrame, manual: DataFrame) -> DataFrame:
    """(archive_id, part, rank, from_id, to_id, kind): timeline edges, then sound manual edges."""
    sound = manual_edges(manual, events).filter("problem is null")
    first = timeline_edges(events).select("archive_id", F.lit(0).alias("part"), F.col("sequence").alias("rank"), "from_id", "to_id", "kind")
    return first.unionByName(sound.select("archive_id", F.lit(1).alias("part"), "rank", "from_id", "to_id", "kind"))


def only_manual(graph: DataFrame) -> DataFrame:
    return graph.filter("kind <> 'next'")


def rebuild_graph(graph: DataFrame, events: DataFrame) -> DataFrame:
    """The graph with its manual edges kept and all else derived anew."""
    return build_graph(events, only_manual(graph).select("archive_id", "from_id", "to_id", "kind"))


def link_events(graph: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph with more manual edges; all of them are checked again."""
    old = only_manual(graph).select("archive_id", "from_id", "to_id", "kind")
    return build_graph(events, old.unionByName(edges.select("archive_id", "from_id", "to_id", "kind")))


def graph_differences(graph: DataFrame, events: DataFrame) -> DataFrame:
    """Edges that a stored graph has and a rebuilt one has not (side ``stored``), and the reverse (``missing``)."""
    columns = ["archive_id", "part", "rank", "from_id", "to_id", "kind"]
    return signed_differences(graph, rebuild_graph(graph, events), columns, ("stored", "missing"))


def inventory(events: DataFrame, graph: DataFrame) -> DataFrame:
    """(archive_id, nodes, timeline_edges, manual_edges)."""
    nodes = events.groupBy("archive_id").agg(F.count("*").alias("nodes"))
    manual = only_manual(graph).groupBy("archive_id").agg(F.count("*").alias("manual_edges"))
    out = nodes.join(manual, "archive_id", "left")
    return out.select("archive_id", "nodes", F.greatest(F.lit(0), F.col("nodes") - 1).cast("long").alias("timeline_edges"), F.coalesce("manual_edges", F.lit(0)).cast("long").alias("manual_edges"))


def role_counts(events: DataFrame) -> DataFrame:
    """(archive_id, role, events, rank) in the order in which roles first appear."""
    c = events.groupBy("archive_id", "role").agg(F.count("*").alias("events"), F.min("sequence").alias("first"))
    return c.select("archive_id", "role", "events", F.row_number().over(Window.partitionBy("archive_id").orderBy("first")).alias("rank"))


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def graph_hashes(graph: DataFrame, events: DataFrame, archives: DataFrame, schema: str = GRAPH_SCHEMA) -> DataFrame:
    """(archive_id, payload_sha256): the hash of nodes and edges as compact JSON."""
    node = F.concat(F.lit('{"id":'), _q(F.col("event_id")), F.lit(',"sequence":'), F.col("sequence").cast("string"), F.lit(',"role":'), _q(F.col("role")), F.lit(',"contentSha256":'), _q(F.col("content_sha256")), F.lit("}"))
    edge = F.concat(F.lit('{"from":'), _q(F.col("from_id")), F.lit(',"to":'), _q(F.col("to_id")), F.lit(',"kind":'), _q(F.col("kind")), F.lit("}"))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), ",")
    nodes = events.groupBy("archive_id").agg(text(F.struct("sequence", node.alias("t"))).alias("nodes"))
    edges = graph.groupBy("archive_id").agg(text(F.struct("part", "rank", edge.alias("t"))).alias("edges"))
    j = archives.join(nodes, "archive_id", "left").join(edges, "archive_id", "left")
    payload = F.concat(
        F.lit(f'{{"schema":"{schema}","archiveId":'), _q(F.col("archive_id").cast("string")), F.lit(',"transcriptSha256":'), _q(F.col("transcript_sha256")),
        F.lit(',"nodes":['), F.coalesce("nodes", F.lit("")), F.lit('],"edges":['), F.coalesce("edges", F.lit("")), F.lit("]}"),
    )
    return j.select("archive_id", sha256(payload).alias("payload_sha256"))
