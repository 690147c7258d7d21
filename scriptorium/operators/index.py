"""The inverted index of each archive: postings, totals, hash and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256, utf16_order
from ..functions.tokens import terms_of, with_nfkc
from ..model import MAX_OCCURRENCES, MAX_TERMS
from .integrity import signed_differences

INDEX_SCHEMA = "scriptorium-index/1"


def event_terms(events: DataFrame) -> DataFrame:
    """(archive_id, event_id, sequence, term): each distinct term of each event."""
    normal = with_nfkc(events.select("archive_id", "event_id", "sequence", "content"), "content", "_normal")
    return normal.select("archive_id", "event_id", "sequence", F.explode(terms_of(F.col("_normal"))).alias("term"))


def postings(terms: DataFrame) -> DataFrame:
    """(archive_id, term, event_ids) with identifiers in sequence order.

    One shuffle; a group is bounded by the events of one archive.
    """
    ids = F.sort_array(F.collect_list(F.struct("sequence", "event_id")))
    return terms.groupBy("archive_id", "term").agg(F.transform(ids, lambda p: p["event_id"]).alias("event_ids"))


def term_ranks(index: DataFrame) -> DataFrame:
    """Postings with each term's rank in its archive, by UTF-16 code units."""
    return index.withColumn("rank", F.row_number().over(Window.partitionBy("archive_id").orderBy(utf16_order(F.col("term")))))


def term_totals(terms: DataFrame) -> DataFrame:
    """(archive_id, occurrences, terms, within_limits)."""
    # counted by (archive, term) first, so the distinct count needs no second pass over the rows
    per_term = terms.groupBy("archive_id", "term").agg(F.count("*").alias("n"))
    out = per_term.groupBy("archive_id").agg(F.sum("n").alias("occurrences"), F.count("*").alias("terms"))
    return out.withColumn("within_limits", (F.col("occurrences") <= MAX_OCCURRENCES) & (F.col("terms") <= MAX_TERMS))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def index_hashes(index: DataFrame, archives: DataFrame, schema: str = INDEX_SCHEMA) -> DataFrame:
    """(archive_id, payload_sha256): the hash of an archive's whole index as compact JSON.

    ``archives`` has archive_id, transcript_sha256 and event_count.  Terms and
    identifiers are letters, digits and underscores, so nothing needs escaping.
    """
    entry = F.concat(F.lit("["), _quoted(F.col("term")), F.lit(",["), F.array_join(F.transform("event_ids", _quoted), ","), F.lit("]]"))
    rows = index.select("archive_id", F.struct(utf16_order(F.col("term")).alias("o"), entry.alias("t")).alias("e"))
    terms = rows.groupBy("archive_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["t"]), ",").alias("terms"))
    j = archives.join(terms, "archive_id", "left")
    payload = F.concat(
        F.lit(f'{{"schema":"{schema}","archiveId":'), _quoted(F.col("archive_id").cast("string")), F.lit(',"transcriptSha256":'), _quoted(F.col("transcript_sha256")),
        F.lit(',"eventCount":'), F.col("event_count").cast("string"), F.lit(',"terms":['), F.coalesce("terms", F.lit("")), F.lit("]}"),
    )
    return j.select("archive_id", sha256(payload).alias("payload_sha256"))


def index_differences(stored: DataFrame, events: DataFrame) -> DataFrame:
    """(archive_id, term, side) where a stored index and one built from the events differ."""
    differ = signed_differences(stored, postings(event_terms(events)), ["archive_id", "term", "event_ids"], ("stored", "missing"))
    return differ.select("archive_id", "term", "side")
