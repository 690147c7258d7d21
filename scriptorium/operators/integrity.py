"""Integrity as tables of violations.

Checks re-derive and compare; they give one row for each breach,
(archive_id, rule, subject), so an intact input gives an empty table and
nothing is decided by an exception half way.  :func:`require_none` turns a
table of violations into an error where a command needs one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_valid_title, sha256, utf16_length, utf16_order
from ..functions.tokens import terms_of
from ..model import ANNOTATION_KINDS, MAX_ANNOTATIONS, MAX_EVENTS, MAX_IMPORT_BYTES, MAX_IMPORT_MESSAGES, MAX_NOTE_UNITS, MAX_OCCURRENCES, MAX_TERMS, ROLES, InputError
from .projection import event_id

HASH = "^[0-9a-f]{64}$"
EVENT_ID = r"^evt_[0-9]{4,}_[0-9a-f]{12}$"


def breaches(df: DataFrame, rules: dict[str, Column], subject: Column, key: str = "archive_id") -> DataFrame:
    """One pass over ``df``: a row for each rule whose condition for a breach holds."""
    found = F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()])
    rows = df.select(key, subject.cast("string").alias("subject"), F.explode(F.array_compact(found)).alias("rule"))
    return rows.select(key, "rule", "subject")


def require_none(violations: DataFrame, what: str) -> None:
    """Raise for the first violations of a table; reads at most three rows."""
    rows = violations.limit(3).collect()
    if rows:
        raise InputError(f"{what}: " + "; ".join(f"{r['rule']} ({r['subject']})" for r in rows))


def event_violations(events: DataFrame) -> DataFrame:
    """Events whose identifier, hash, role or place is not what the messages give."""
    w = Window.partitionBy("archive_id").orderBy("sequence")
    e = events.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("archive_id"))).withColumn("_same", F.count("*").over(Window.partitionBy("archive_id", "event_id")))
    rules = {
        "event id format": ~F.col("event_id").rlike(EVENT_ID),
        "event id differs": F.col("event_id") != event_id(F.col("sequence"), F.col("role"), F.col("content")),
        "content hash differs": F.col("content_sha256") != sha256(F.col("content")),
        "role unknown": ~F.col("role").isin(*ROLES),
        "sequence broken": F.col("sequence") != F.col("_at"),
        "event id repeated": F.col("_same") > 1,
        "too many events": (F.col("_n") > MAX_EVENTS) & (F.col("_at") == 0),
    }
    return breaches(e, rules, F.col("sequence"))


def archive_violations(archives: DataFrame) -> DataFrame:
    """Archives (archive_id, title, transcript, transcript_sha256, byte_length, created_at) that break a rule of their own fields."""
    rules = {
        "title": ~is_valid_title(F.col("title")),
        "transcript hash differs": F.col("transcript_sha256") != sha256(F.col("transcript")),
        "transcript length differs": F.col("byte_length") != F.octet_length("transcript"),
        "created_at": F.try_to_timestamp("created_at").isNull(),
    }
    return breaches(archives, rules, F.col("archive_id"))


def import_violations(imports: DataFrame) -> DataFrame:
    """Imports (archive_id, title, messages) that break a rule."""
    m = F.col("messages")
    size = F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x["content"]), F.lit(0)))
    rules = {
        "title": ~is_valid_title(F.col("title")),
        "message count": ~F.size(m).between(1, MAX_IMPORT_MESSAGES),
        "role unknown": ~F.forall(m, lambda x: F.coalesce(x["role"].isin(*ROLES), F.lit(False))),
        "content missing": F.exists(m, lambda x: x["content"].isNull()),
        "too large": size > MAX_IMPORT_BYTES,
    }
    return breaches(imports, rules, F.col("archive_id"))


def field_violations(raw: DataFrame, allowed: list[str], column: str = "raw") -> DataFrame:
    """JSON texts with keys that are not allowed; a fixed schema would drop those silently."""
    extra = F.array_except(F.json_object_keys(column), F.array(*[F.lit(x) for x in allowed]))
    return raw.select("archive_id", F.lit("unknown field").alias("rule"), F.explode(extra).alias("subject"))


def annotation_violations(annotations: DataFrame, events: DataFrame, adding: bool = False) -> DataFrame:
    """Annotations of unknown events or kinds, with long notes or bad dates; an empty note may be read but not added."""
    known = events.select("archive_id", "event_id").distinct().withColumn("_known", F.lit(True))
    a = annotations.join(known, ["archive_id", "event_id"], "left").withColumn("_n", F.count("*").over(Window.partitionBy("archive_id")))
    rules = {
        "unknown event": F.col("_known").isNull(),
        "kind": ~F.col("kind").isin(*ANNOTATION_KINDS),
        "note": ~utf16_length(F.col("note")).between(1 if adding else 0, MAX_NOTE_UNITS),
        "created_at": F.try_to_timestamp("created_at").isNull(),
        "too many": F.col("_n") > MAX_ANNOTATIONS,
    }
    return breaches(a, rules, F.col("pos"))


def index_violations(index: DataFrame, events: DataFrame) -> DataFrame:
    """Postings (archive_id, pos, term, event_ids) that break order, form or reference, or exceed the limits."""
    w = Window.partitionBy("archive_id").orderBy("pos")
    every = Window.partitionBy("archive_id")
    i = index.withColumn("_before", F.lag("term").over(w)).withColumn("_terms", F.count("*").over(every)).withColumn("_all", F.sum(F.size("event_ids")).over(every))
    alone = terms_of(F.col("term"))
    rules = {
        "term order": F.coalesce(utf16_order(F.col("_before")) >= utf16_order(F.col("term")), F.lit(False)),
        "term form": (F.size(alone) != 1) | (F.coalesce(F.try_element_at(alone, F.lit(1)), F.lit("")) != F.col("term")),
        "no postings": F.size("event_ids") == 0,
        "posting repeated": F.size(F.array_distinct("event_ids")) != F.size("event_ids"),
        "too many terms": (F.col("_terms") > MAX_TERMS) & (F.col("pos") == 0),
        "too many occurrences": (F.col("_all") > MAX_OCCURRENCES) & (F.col("pos") == 0),
    }
    own = breaches(i, rules, F.col("term"))
    refs = index.select("archive_id", "term", F.explode("event_ids").alias("event_id"))
    lost = refs.join(events.select("archive_id", "event_id"), ["archive_id", "event_id"], "left_anti")
    return own.unionByName(lost.select("archive_id", F.lit("unknown event").alias("rule"), F.col("term").alias("subject")))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def signed_differences(stored: DataFrame, derived: DataFrame, columns: list[str], sides: tuple[str, str]) -> DataFrame:
    """Rows that one table has more often than the other, as often as that, with their side; both are read once."""
    both = stored.select(*columns, F.lit(1).alias("_n")).unionByName(derived.select(*columns, F.lit(-1).alias("_n")))
    odd = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    odd = odd.withColumn("side", F.when(F.col("_n") > 0, sides[0]).otherwise(sides[1]))
    return odd.select(*columns, "side", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))).alias("_n")).drop("_n")


def rederived_differences(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows only in the stored table or only in the derived one, with their side."""
    return signed_differences(stored, derived, [c for c in derived.columns if c in stored.columns], ("stored", "derived"))


def recorder_caps(messages: DataFrame, max_message: int, max_messages: int, max_bytes: int) -> DataFrame:
    """Messages with ``accepted`` and the running totals that decide it.

    A message over its own limit is refused and leaves the totals as they are.
    The first message that would pass a total ends the recording: it and all
    that follow are refused.
    """
    size = F.octet_length("content").cast("long")
    w = Window.partitionBy("archive_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = messages.withColumn("bytes", size).withColumn("_ok", F.col("bytes") <= max_message)
    m = m.withColumn("total_messages", F.count_if("_ok").over(w)).withColumn("total_bytes", F.sum(F.when(F.col("_ok"), F.col("bytes")).otherwise(0)).over(w))
    return m.withColumn("accepted", F.col("_ok") & (F.col("total_messages") <= max_messages) & (F.col("total_bytes") <= max_bytes)).drop("_ok")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


