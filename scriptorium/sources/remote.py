"""Shared pages by request: every rule of a request and its answer as columns.

Nothing here goes to the network by itself.  A caller gives the function that
answers one request, :func:`http_get` for the real thing; it is called where
the rows are, once for each page and redirect.  What decides is in columns:
whose page a URL is, whether a redirect leads to an allowed one, status, type,
size and encoding.  Answers are written down after each round, so that a lost
executor costs requests of that round alone.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import sha256
from ..sinks.tables import scratch_folder
from .snapshots import MAX_PAGE_BYTES, import_snapshots, share_provider

MAX_REDIRECTS = 3
TIMEOUT = 10.0
# What is asked for, and the types of a page.
ACCEPT = "text/html,application/xhtml+xml"
PAGE_TYPE = r"(?i)^(?:text/html|application/xhtml\+xml)(?:;|$)"
SNAPSHOT_SCHEMA = "shared-snapshot/0.1"
SNAPSHOT_WARNING = "A page as it was sent. It is not to be trusted and no transcript was made of it."

ANSWER = [StructField("_status", IntegerType()), StructField("_target", StringType()), StructField("_kind", StringType()), StructField("_said", LongType()), StructField("_body", BinaryType()), StructField("_took", DoubleType()), StructField("_failure", StringType())]


@dataclass(frozen=True)
class Answer:
    """One answer: headers have lower-case names, and ``chunks`` is read no further than a page may be long."""

    status: int
    headers: dict[str, str]
    chunks: Iterator[bytes]


#: Answers a request for a URL within so many seconds; it gets the row's other columns too.
Get = Callable[[str, float, dict], Answer]


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def http_get(url: str, timeout: float, row: dict) -> Answer:
    """A request over the network, without cookies, credentials or redirects."""
    request = urllib.request.Request(url, headers={"Accept": ACCEPT, "User-Agent": "scriptorium"})
    try:
        r = urllib.request.build_opener(_Stay).open(request, timeout=timeout)
    except urllib.error.HTTPError as e:
        r = e
    return Answer(r.status, {k.lower(): v for k, v in r.headers.items()}, iter(lambda: r.read(1 << 16), b""))


def _bounded(chunks: Iterator[bytes], most: int, until: float) -> bytes:
    """No more than one chunk over what a page may have."""
    out = bytearray()
    for chunk in chunks:
        out += chunk
        if time.monotonic() > until:
            raise TimeoutError
        if len(out) > most:
            break
    return bytes(out)


def answered(requests: DataFrame, get: Get, timeout: float, max_bytes: int) -> DataFrame:
    """``requests`` (url, _current, _spent and more) with the answer to ``_current``; ``_failure`` where there is none."""
    names = requests.columns

    def one(row: dict) -> tuple:
        began = time.monotonic()
        left = timeout - row["_spent"]
        try:
            if left <= 0:
                raise TimeoutError
            a = get(row["_current"], left, row)
            said = a.headers.get("content-length", "")
            there = a.headers.get("location") if 300 <= a.status < 400 else None
            said = int(said) if said.isascii() and said.isdigit() and len(said) < 19 else None
            body = _bounded(a.chunks, max_bytes, began + left) if 200 <= a.status < 300 and (said or 0) <= max_bytes else b""
            out = (a.status, there and urljoin(row["_current"], there), a.headers.get("content-type", ""), said, body)
            failure = None
        except TimeoutError:
            out, failure = (None,) * 5, "timed out"
        except (OSError, ValueError) as e:
            out, failure = (None,) * 5, "timed out" if "timed out" in str(e) else "unreachable"
        return (*out, time.monotonic() - began, failure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.float64(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):  # a batch of one: a page may be large
                few = batch.slice(i, 1)
                got = one(few.to_pylist()[0])
                yield pa.RecordBatch.from_arrays([*few.columns, *[pa.array([v], t) for v, t in zip(got, types)]], [*names, *[f.name for f in ANSWER]])

    return requests.mapInArrow(run, StructType([*requests.schema.fields, *ANSWER]))


def fetch_pages(urls: DataFrame, get: Get, timeout: float = TIMEOUT, max_bytes: int = MAX_PAGE_BYTES, max_redirects: int = MAX_REDIRECTS) -> DataFrame:
    """(archive_id, url, provider, html_bytes, source_url_sha256, source_html_sha256, byte_length, error) of rows (archive_id, url, and what ``get`` is to have).

    Without an error a page is whole, and with one there is no page.  Each
    redirect is checked as the URL itself is; the time is that of all requests
    of a page.  A null URL is none that is allowed.
    """
    if not 0 < timeout <= TIMEOUT:
        raise ValueError(f"a page has up to {TIMEOUT} seconds")
    spark, given = urls.sparkSession, urls.columns
    pending = urls.withColumn("_current", F.col("url")).withColumn("_spent", F.lit(0.0)).withColumn("provider", share_provider(F.col("url")))
    columns = ["archive_id", "url", "provider", "_body", "error"]
    no_body = F.lit(None).cast("binary").alias("_body")
    done = [pending.filter("provider is null").select("archive_id", "url", "provider", no_body, F.lit("url not allowed").alias("error"))]
    pending = pending.filter("provider is not null")
    for turn in range(max_redirects + 1):
        folder = scratch_folder(spark)
        answered(pending, get, timeout, max_bytes).write.parquet(folder)
        a = spark.read.parquet(folder)
        away = F.coalesce(F.col("_status").between(300, 399), F.lit(False))
        there = share_provider(F.col("_target"))
        error = (
            F.when(F.col("_failure").isNotNull(), F.col("_failure")).when(away & F.col("_target").isNull(), "redirect without a location").when(away & there.isNull(), "redirect not allowed").when(away & F.lit(turn == max_redirects), "too many redirects")
            .when(~away & ~F.col("_status").between(200, 299), F.concat(F.lit("status "), F.col("_status"))).when(~away & ~F.col("_kind").rlike(PAGE_TYPE), "no page")
            .when(~away & ((F.col("_said") > max_bytes) | (F.length("_body") > max_bytes)), "too large").when(~away & ~F.is_valid_utf8(F.col("_body").cast("string")), "not UTF-8")
        )
        a = a.withColumn("error", error)
        done.append(a.filter(~away | F.col("error").isNotNull()).select("archive_id", "url", "provider", F.when(F.col("error").isNull(), F.col("_body")).alias("_body"), "error"))
        pending = a.filter(away & F.col("error").isNull()).select(*given, F.col("_target").alias("_current"), (F.col("_spent") + F.col("_took")).alias("_spent"), there.alias("provider"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part.select(columns))
    return out.select("archive_id", "url", "provider", F.col("_body").alias("html_bytes"), sha256(F.col("url")).alias("source_url_sha256"), F.sha2("_body", 256).alias("source_html_sha256"), F.length("_body").cast("long").alias("byte_length"), "error")


def snapshots_of(pages: DataFrame, captured_at: str) -> DataFrame:
    """(archive_id, name, html_bytes, meta) of fetched pages without an error, as a folder of snapshots has them."""
    meta = F.struct(
        F.lit(SNAPSHOT_SCHEMA).alias("schema"), "provider", F.lit(captured_at).alias("capturedAt"), F.col("source_url_sha256").alias("sourceUrlSha256"), F.col("source_html_sha256").alias("pageSha256"),
        F.col("byte_length").alias("byteLength"), F.lit("none").alias("parser"), F.lit(SNAPSHOT_WARNING).alias("warning"),
    )
    sound = pages.filter("error is null")
    return sound.select("archive_id", F.concat(F.lit("snapshot-"), F.left("source_html_sha256", F.lit(16))).alias("name"), "html_bytes", F.to_json(meta).alias("meta"))


def import_shared(pages: DataFrame, captured_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archives, events, violations) of fetched pages; a page that could not be had is a violation with its error."""
    archives, events, bad = import_snapshots(snapshots_of(pages, captured_at))
    missed = pages.filter("error is not null").select("archive_id", F.col("error").alias("rule"), F.col("url").alias("subject"))
    return archives.withColumn("capture_method", F.lit("public_shared_link")), events, bad.unionByName(missed)
