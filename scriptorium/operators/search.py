"""The two searches: conjunction of terms over an index, and substring scan.

They differ in meaning and are not two ways to one result: terms may stand
anywhere in an event, a substring must be contiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, is_text
from ..functions.tokens import query_terms, scan_query, terms_of, with_nfkc
from ..model import MAX_QUERY_TERMS, MAX_QUERY_UNITS

BEFORE, AFTER = 100, 180


def matching_events(index: DataFrame, terms: list[str]) -> DataFrame:
    """(archive_id, event_id) of events that hold all terms, from postings.

    The filter on ``term`` reaches the scan of a stored index, so only the
    queried terms' postings are read.
    """
    hits = index.filter(F.col("term").isin(terms)).select("archive_id", "term", F.explode("event_ids").alias("event_id"))
    return hits.groupBy("archive_id", "event_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(terms)).drop("n")


def term_snippet(content: Column, normal: Column, terms: list[str]) -> Column:
    """Text around the earliest term; the place is found in the NFKC form and cut from the content."""
    places = F.filter(F.array(*[F.instr(F.lower(normal), t) for t in terms]), lambda p: p > 0)
    at = F.coalesce(F.array_min(places) - 1, F.lit(0))
    return excerpt(content, at - BEFORE, at + AFTER)


def search_terms(events: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """(archive_id, event_id, sequence, role, score, snippet) of events that hold every term of the query."""
    terms = query_terms(query)
    hits = events.join(matching_events(index, terms), ["archive_id", "event_id"], "left_semi")
    hits = with_nfkc(hits, "content", "_normal")
    return hits.select("archive_id", "event_id", "sequence", "role", F.lit(len(terms)).alias("score"), term_snippet(F.col("content"), F.col("_normal"), terms).alias("snippet"))


def checked_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query, terms, problem) of a table of queries; the rules are those of :func:`query_terms`, as columns."""
    text = F.coalesce("query", F.lit(""))
    q = with_nfkc(queries.select("query_id", text.alias("query")), "query", "_normal").withColumn("terms", terms_of(F.col("_normal")))
    problem = F.when(~is_text(F.col("query"), MAX_QUERY_UNITS), "length or control character").when(~F.size("terms").between(1, MAX_QUERY_TERMS), "number of terms")
    return q.select("query_id", "query", "terms", problem.alias("problem"))


def query_violations(queries: DataFrame) -> DataFrame:
    """(query_id, rule, subject) of queries that no search takes."""
    return checked_queries(queries).filter("problem is not null").select("query_id", F.col("problem").alias("rule"), F.col("query").alias("subject"))


def search_batch(events: DataFrame, index: DataFrame, queries: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """(query_id, archive_id, event_id, sequence, role, score, snippet) for all queries (query_id, query) in one pass.

    Postings and events are read once, however many queries there are.  The
    postings of a query's terms meet by archive and are intersected there, so
    what is shuffled is a row for each term and archive.  Queries that
    :func:`query_violations` names find nothing.  The side of the queries is
    counted, and broadcast up to ``broadcast_rows`` terms.
    """
    sound = checked_queries(queries).filter("problem is null").select("query_id", "terms", F.size("terms").alias("score"))
    asked = sound.select("query_id", "score", F.explode("terms").alias("term"))
    small = F.broadcast if asked.count() <= broadcast_rows else (lambda df: df)
    lists = index.join(small(asked), "term").groupBy("query_id", "score", "archive_id").agg(F.collect_list("event_ids").alias("lists")).filter(F.size("lists") == F.col("score"))
    found = lists.select("query_id", "archive_id", F.explode(_common("lists")).alias("event_id"))
    hits = events.join(found, ["archive_id", "event_id"]).join(small(sound), "query_id")
    hits = with_nfkc(hits, "content", "_normal")
    places = F.filter(F.transform("terms", lambda t: F.position(t, F.lower("_normal"))), lambda p: p > 0)
    at = F.coalesce(F.array_min(places) - 1, F.lit(0))
    return hits.select("query_id", "archive_id", "event_id", "sequence", "role", "score", excerpt(F.col("content"), at - BEFORE, at + AFTER).alias("snippet"))


def _common(lists: str) -> Column:
    """The identifiers that all lists have."""
    return F.aggregate(F.slice(lists, 2, MAX_QUERY_TERMS), F.element_at(lists, 1), lambda have, more: F.array_intersect(have, more))


def search_bucketed(events: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """:func:`search_terms` over tables that are bucketed by archive alike: no row of either is shuffled."""
    terms = query_terms(query)
    lists = index.filter(F.col("term").isin(terms)).groupBy("archive_id").agg(F.collect_list("event_ids").alias("lists")).filter(F.size("lists") == len(terms))
    # joined on the bucket's key alone, as a join on more keys would be shuffled by all of them
    hits = events.join(lists.select("archive_id", _common("lists").alias("_ids")).hint("merge"), "archive_id").filter(F.array_contains("_ids", F.col("event_id")))
    hits = with_nfkc(hits.drop("_ids"), "content", "_normal")
    return hits.select("archive_id", "event_id", "sequence", "role", F.lit(len(terms)).alias("score"), term_snippet(F.col("content"), F.col("_normal"), terms).alias("snippet"))


def search_scan(events: DataFrame, query: str) -> DataFrame:
    """(archive_id, event_id, sequence, role, snippet) of events that contain the query, in any case."""
    target = scan_query(query)
    at = F.instr(F.lower("content"), target)
    hits = events.select("archive_id", "event_id", "sequence", "role", "content", at.alias("at")).filter("at > 0")
    return hits.select("archive_id", "event_id", "sequence", "role", excerpt(F.col("content"), F.col("at") - 1 - BEFORE, F.col("at") - 1 + len(query) + AFTER).alias("snippet"))


def top_hits(hits: DataFrame, limit: int = 7) -> DataFrame:
    """The first hits of each archive with their rank; higher scores, then earlier events come first."""
    order = [F.col("score").desc()] if "score" in hits.columns else []
    w = Window.partitionBy("archive_id").orderBy(*order, "sequence")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
