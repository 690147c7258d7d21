"""Snapshots of shared pages: HTML files and their metadata, checked before they are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html_text import parse_shared
from ..functions.text import sha256
from ..operators.integrity import field_violations, union_all
from ..operators.projection import project_events, render_transcripts

MAX_PAGE_BYTES = 5 << 20
# Whose pages may be read, and where they lie.
SHARE_URLS = (("chatgpt", "chatgpt.com", "/share/"), ("claude", "claude.ai", "/share/"), ("gemini", "g.co", "/gemini/share/"), ("gemini", "gemini.google.com", "/share/"))
META_FIELDS = ["schema", "provider", "capturedAt", "sourceUrlSha256", "pageSha256", "byteLength", "parser", "warning"]
META = "struct<schema:string,provider:string,capturedAt:string,sourceUrlSha256:string,pageSha256:string,byteLength:bigint,parser:string,warning:string>"
HASH = "^[0-9a-f]{64}$"


def share_provider(url: Column) -> Column:
    """Who shares a page at a URL; null for other hosts and for URLs with credentials, port, query or fragment."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    clean = (part("PROTOCOL") == "https") & part("USERINFO").isNull() & part("QUERY").isNull() & part("REF").isNull() & ~part("AUTHORITY").contains(":") & (part("HOST") == F.lower(part("HOST")))
    who = F.lit(None).cast("string")
    for provider, host, prefix in SHARE_URLS:
        who = F.when((part("HOST") == host) & part("PATH").startswith(prefix), provider).otherwise(who)
    return F.when(clean, who)


def snapshot_violations(snapshots: DataFrame) -> DataFrame:
    """(archive_id, rule, subject) of snapshots (archive_id, html_bytes, meta): form of the metadata, then length and hash."""
    m = snapshots.select("archive_id", "html_bytes", F.from_json("meta", META).alias("m"))
    ok = lambda c: F.coalesce(c, F.lit(False))
    rule = (
        F.when(~ok(F.col("m.provider").isin("chatgpt", "claude", "gemini")), "provider")
        .when(F.try_to_timestamp("m.capturedAt").isNull(), "capturedAt")
        .when(~ok(F.col("m.sourceUrlSha256").rlike(HASH)) | ~ok(F.col("m.pageSha256").rlike(HASH)), "hash form")
        .when(~ok(F.col("m.byteLength").between(1, MAX_PAGE_BYTES)), "length form")
        .when(~ok(F.col("m.parser") == "none"), "parser")
        .when(F.length("html_bytes") != F.col("m.byteLength"), "length differs")
        .when(F.sha2("html_bytes", 256) != F.col("m.pageSha256"), "hash differs")
        .when(~F.is_valid_utf8(F.col("html_bytes").cast("string")), "not UTF-8")
    )
    own = m.select("archive_id", rule.alias("rule"), F.col("m.provider").alias("subject")).filter("rule is not null")
    return union_all([own, field_violations(snapshots.select("archive_id", F.col("meta").alias("raw")), META_FIELDS)])


def import_snapshots(snapshots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archives, events, violations) of snapshots; those with a violation are not parsed."""
    bad = snapshot_violations(snapshots)
    sound = snapshots.join(bad.select("archive_id").distinct(), "archive_id", "left_anti")
    parsed = sound.select("archive_id", F.get_json_object("meta", "$.sourceUrlSha256").alias("source_url_sha256"), F.sha2("html_bytes", 256).alias("source_html_sha256"), parse_shared(F.decode("html_bytes", "UTF-8")).alias("p"))
    failed = parsed.filter("p.error is not null").select("archive_id", F.col("p.error").alias("rule"), F.lit(None).cast("string").alias("subject"))
    good = parsed.filter("p.error is null").select("archive_id", "source_url_sha256", "source_html_sha256", "p.title", "p.parser", F.posexplode("p.messages").alias("sequence", "m"))
    events = project_events(good.select("archive_id", "sequence", F.col("m.role").alias("role"), F.col("m.content").alias("content")))
    heads = good.filter("sequence = 0").select("archive_id", "title", "parser", "source_url_sha256", "source_html_sha256", F.lit("public_shared_snapshot").alias("capture_method"), F.lit(False).alias("hidden_state_available"))
    archives = heads.join(render_transcripts(events, heads.select("archive_id", "title")), "archive_id").withColumn("transcript_sha256", sha256(F.col("transcript")))
    return archives, events, bad.unionByName(failed)


def load_snapshots(spark: SparkSession, html_path: str, meta_path: str) -> DataFrame:
    """(archive_id, html_bytes, meta): pages and metadata files of the same name but for their last suffix."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.metadata)?\.[^.]*$", "")
    pages = spark.read.format("binaryFile").load(html_path).select(stem.alias("stem"), F.col("content").alias("html_bytes"))
    metas = spark.read.format("binaryFile").load(meta_path).select(stem.alias("stem"), F.decode("content", "UTF-8").alias("meta"))
    return pages.join(metas, "stem").select(F.xxhash64("stem").alias("archive_id"), "html_bytes", "meta")
