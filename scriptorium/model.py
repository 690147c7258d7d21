"""Relations of the engine, their limits and the adapters that fill them.

The central relation is ``events``: one row for each message of an archive,
keyed by (archive_id, event_id), for the same message gives the same event_id
in two archives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Enumerations.
ROLES = ("unknown", "user", "assistant", "tool", "system")
HEADING_ROLES = ("user", "assistant", "tool", "system")
SHARED_ROLES = ("user", "assistant")
ANNOTATION_KINDS = ("decision", "important", "question", "pin")
GRAPH_KINDS = ("supports", "clarifies", "supersedes", "depends_on", "answers", "relates_to")

# Limits.
MAX_TITLE = 120
MAX_EVENTS = 100_000
MAX_IMPORT_MESSAGES = 10_000
MAX_IMPORT_BYTES = 4 << 20
MAX_FILE_BYTES = 10 << 20
MAX_MESSAGE_BYTES = 1 << 20
MAX_TERMS = 100_000
MAX_OCCURRENCES = 500_000
MAX_QUERY_TERMS = 16
MAX_QUERY_UNITS = 256
MAX_TERM_UNITS = 128
MAX_EVIDENCE = 20
EVIDENCE_BYTES = 120_000
MAX_ANNOTATIONS = 1_000
MAX_NOTE_UNITS = 2_000
MAX_MANUAL_EDGES = 20_000
MAX_MAP_EVENTS = 80
PREVIEW = 700
MAX_PACKAGE_BYTES = 24 << 20
MAX_SECRET_BYTES = 12 << 20
DEFAULT_TITLE = "Untitled conversation"

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
EVENTS = T.StructType(
    [
        T.StructField("archive_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("sequence", T.IntegerType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("content_sha256", T.StringType()),
    ]
)
ANNOTATIONS = "archive_id long, pos int, event_id string, kind string, note string, created_at string"
EDGES = "archive_id long, from_id string, to_id string, kind string"
POSTINGS = "archive_id long, term string, event_ids array<string>"

#: JavaScript's white space, as a regular-expression class for both engines.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CONTROL = r"[\x00-\x1F\x7F]"
UNSAFE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


class InputError(ValueError):
    """An argument that no query should be planned for."""


def messages_of(conversations: DataFrame) -> DataFrame:
    """(archive_id, sequence, role, content) from the table of conversations."""
    c = conversations
    return c.select(c["conv_id"].alias("archive_id"), c["turn"].cast("int").alias("sequence"), c["role"], c["text"].alias("content"))
