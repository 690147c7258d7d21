"""Markdown transcripts to messages."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sha256, title_of
from ..model import MESSAGE, InputError
from ..operators.projection import explode_messages, project_events
from .files import empty_files

#: JavaScript's white space, by which the heading rule is stated.
_SPACE = "\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: A role heading and the blank lines after it; the line's end is not part of it.
_HEADING = re.compile(rf"(?:^|(?<=[\n\r  ]))##[{_SPACE}]+(user|assistant|tool|system)[{_SPACE}]*(?=[\n\r  ]|\Z)", re.I | re.A)
_END = re.compile(r"(?:\r?\n){2}\Z")
_LINE_END = re.compile(r"\r?\n")


def messages_in(transcript: str) -> list[tuple[str, str]]:
    """(role, content) of a transcript.

    Text before the first role heading belongs to no message; without any
    heading the whole is one message of unknown role.  Blank lines after a
    heading and exactly two line ends before the next one are not content.
    """
    heads = list(_HEADING.finditer(transcript))
    if not heads:
        return [("unknown", transcript)]
    out = []
    for here, after in zip(heads, [*heads[1:], None]):
        at = here.end()
        if m := _LINE_END.match(transcript, at):
            at = m.end()
        out.append((here[1].lower(), _END.sub("", transcript[at : after.start() if after else len(transcript)])))
    return out


_MESSAGE = pa.struct([("role", pa.string()), ("content", pa.string())])


@F.arrow_udf(T.ArrayType(MESSAGE))
def markdown_split(transcripts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else [{"role": r, "content": c} for r, c in messages_in(t)] for t in transcripts.to_pylist()], pa.list_(_MESSAGE))


def markdown_messages(transcripts: DataFrame, column: str = "transcript") -> DataFrame:
    """(archive_id, sequence, role, content) of (archive_id, transcript)."""
    return explode_messages(transcripts.withColumn("_m", markdown_split(column)), "_m")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(archive_id, source_name, transcript, transcript_sha256, byte_length, title) of Markdown files.

    The archive's identifier comes from the path, so reruns agree.  Files that
    are empty or not UTF-8 are an error when they are read.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    if none := empty_files(raw).limit(3).collect():
        raise InputError("not a non-empty UTF-8 text: " + ", ".join(r["path"] for r in none))
    name = F.left(F.element_at(F.split("path", "/"), -1), F.lit(160))
    ok = F.is_valid_utf8(F.col("content").cast("string")) & (F.length("content") > 0)
    text = F.when(ok, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("not a non-empty UTF-8 text: "), "path")))
    df = raw.select(F.xxhash64("path").alias("archive_id"), name.alias("source_name"), text.alias("transcript"))
    return df.select("*", sha256(F.col("transcript")).alias("transcript_sha256"), F.octet_length("transcript").alias("byte_length"), title_of(F.col("transcript")).alias("title"))


def import_markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(archives, events) of Markdown files."""
    archives = read_markdown(spark, path)
    return archives, project_events(markdown_messages(archives))


