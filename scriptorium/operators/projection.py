"""Events from messages, and transcripts from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import close_fence, role_heading, sha256

NUL = "\u0000"


def event_id(sequence: Column, role: Column, content: Column) -> Column:
    """``evt_``, the number from 1 on at least four digits, and 12 digits of the message's hash."""
    number = (sequence + 1).cast("string")
    digest = sha256(F.concat(sequence.cast("string"), F.lit(NUL), role, F.lit(NUL), content))
    return F.concat(F.lit("evt_"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")), F.lit("_"), F.left(digest, F.lit(12)))


def project_events(messages: DataFrame) -> DataFrame:
    """Events from (archive_id, sequence, role, content)."""
    c = F.col("content")
    return messages.select("archive_id", event_id(F.col("sequence"), F.col("role"), c).alias("event_id"), "sequence", "role", "content", sha256(c).alias("content_sha256"))


def explode_messages(imports: DataFrame, column: str = "messages") -> DataFrame:
    """(archive_id, sequence, role, content) from an array of messages; the position is the sequence."""
    rows = imports.select("archive_id", F.posexplode(column).alias("sequence", "m"))
    return rows.select("archive_id", "sequence", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def ordered_concat(df: DataFrame, keys: list[str], order: str, text: str, out: str, separator: str = "\n") -> DataFrame:
    """``text`` of each key's rows joined in the order of a column; bounded by an archive."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias(out))


def render_transcripts(messages: DataFrame, titles: DataFrame) -> DataFrame:
    """(archive_id, transcript): title, then a heading and the content of each message."""
    sections = messages.select("archive_id", "sequence", F.concat(role_heading(F.col("role")), F.lit("\n\n"), close_fence(F.col("content")), F.lit("\n")).alias("section"))
    body = ordered_concat(sections, ["archive_id"], "sequence", "section", "body")
    return body.join(titles, "archive_id").select("archive_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("body")).alias("transcript"))


def inspect_events(events: DataFrame) -> DataFrame:
    """Events without their content."""
    return events.select("archive_id", "event_id", "sequence", "role", "content_sha256")
