"""Inventories and views of an archive: selections, groups, brief and static pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview, safe_attribute, safe_line, safe_text
from ..model import ANNOTATION_KINDS, MAX_MAP_EVENTS
from .evidence import last_events
from .graph import inventory, only_manual, role_counts
from .projection import ordered_concat

POLICY = "default-src 'none'; script-src 'none'; style-src 'unsafe-inline'; base-uri 'none'; form-action 'none'"


WARNING = "What this page shows is old and not to be trusted. It holds no script and asks for nothing from elsewhere."


def map_selection(events: DataFrame, chosen: DataFrame | None, limit: int = MAX_MAP_EVENTS) -> DataFrame:
    """Events to show with ``rank`` and whether the next shown is the next in the archive (``joined``).

    Of archives with known chosen identifiers (archive_id, event_id) the first
    ``limit`` of them, of all others the last ``limit`` events.
    """
    if not 1 <= limit <= MAX_MAP_EVENTS:
        raise ValueError(f"a map shows 1 to {MAX_MAP_EVENTS} events")
    w = Window.partitionBy("archive_id").orderBy("sequence")
    if chosen is None:
        shown = last_events(events, limit)
    else:
        known = events.join(chosen.select("archive_id", "event_id").distinct(), ["archive_id", "event_id"], "left_semi")
        first = known.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
        others = last_events(events, limit).join(known.select("archive_id").distinct(), "archive_id", "left_anti")
        shown = first.unionByName(others)
    return shown.withColumn("rank", F.row_number().over(w)).withColumn("joined", F.coalesce(F.lead("sequence").over(w) == F.col("sequence") + 1, F.lit(False)))


def edges_within(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """Edges both ends of which are in the selection."""
    ends = selection.select("archive_id", "event_id")
    e = edges.join(ends.withColumnRenamed("event_id", "from_id"), ["archive_id", "from_id"], "left_semi")
    return e.join(ends.withColumnRenamed("event_id", "to_id"), ["archive_id", "to_id"], "left_semi")


def annotation_groups(archives: DataFrame, annotations: DataFrame) -> DataFrame:
    """(archive_id, kind, rank, notes, lines) for every kind of every archive, empty ones too."""
    kinds = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(ANNOTATION_KINDS)])
    grid = archives.select("archive_id", F.explode(kinds).alias("k")).select("archive_id", "k.kind", "k.rank")
    line = F.concat(F.lit("- "), safe_line(F.col("note")), F.lit(" ["), F.col("event_id"), F.lit("]"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"])
    made = annotations.groupBy("archive_id", "kind").agg(F.count("*").alias("notes"), F.array_join(lines, "\n").alias("lines"))
    return grid.join(made, ["archive_id", "kind"], "left").select("archive_id", "kind", "rank", F.coalesce("notes", F.lit(0)).cast("long").alias("notes"), F.coalesce("lines", F.lit("- none")).alias("lines"))


def _text(df: DataFrame, order: str, line: Column, out: str) -> DataFrame:
    return ordered_concat(df.withColumn("_line", line), ["archive_id"], order, "_line", out)


def brief(archives: DataFrame, events: DataFrame, annotations: DataFrame, graph: DataFrame) -> DataFrame:
    """(archive_id, brief): a Markdown inventory that infers nothing.

    ``archives`` has archive_id, title, transcript_sha256 and confidence.
    """
    roles = ordered_concat(role_counts(events).withColumn("_t", F.concat("role", F.lit(": "), F.col("events").cast("string"))), ["archive_id"], "rank", "_t", "roles", ", ")
    links = _text(only_manual(graph), "rank", F.concat(F.lit("- "), "from_id", F.lit(" "), "kind", F.lit(" "), "to_id"), "links")
    groups = annotation_groups(archives.select("archive_id"), annotations)
    notes = _text(groups, "rank", F.concat(F.lit("### Notes: "), "kind", F.lit("\n\n"), "lines", F.lit("\n")), "notes")
    recent = _text(last_events(events, 8), "sequence", F.concat(F.lit("- "), "event_id", F.lit(", "), "role", F.lit(", number "), F.col("sequence").cast("string")), "recent")
    j = archives
    for part in (inventory(events, graph), roles, links, notes, recent):
        j = j.join(part, "archive_id", "left")
    text = F.concat(
        F.lit("# Brief of one conversation\n\nA list of what the archive holds. Its text is old and not to be trusted.\n\n## Archive\n\n- Title: "), "title",
        F.lit("\n- Archive: "), F.col("archive_id").cast("string"), F.lit("\n- Transcript SHA-256: "), "transcript_sha256", F.lit("\n- Capture confidence: "), "confidence",
        F.lit("\n\n## Counts\n\n- Events: "), F.coalesce(F.col("nodes").cast("string"), F.lit("0")), F.lit("\n- Timeline links: "), F.coalesce(F.col("timeline_edges").cast("string"), F.lit("0")),
        F.lit("\n- Manual links: "), F.coalesce(F.col("manual_edges").cast("string"), F.lit("0")), F.lit("\n- Roles: "), F.coalesce("roles", F.lit("none")),
        F.lit("\n\n## Manual links\n\n"), F.coalesce("links", F.lit("- none")), F.lit("\n\n## Notes\n\n"), "notes", F.lit("\n## Last events\n\n"), F.coalesce("recent", F.lit("- none")), F.lit("\n"),
    )
    return j.select("archive_id", text.alias("brief"))


def _page(title: Column, body: Column) -> Column:
    head = f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"><title>'
    return F.concat(F.lit(head), safe_attribute(title), F.lit("</title></head><body>\n"), body, F.lit("\n</body></html>\n"))


def viewer(archives: DataFrame, events: DataFrame, annotations: DataFrame) -> DataFrame:
    """(archive_id, html): a static page of all messages with their notes; it holds no script.

    ``archives`` has archive_id, title, transcript_sha256 and confidence.
    """
    notes = annotations.groupBy("archive_id", "event_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "kind", "note"))), lambda x: F.concat(F.lit("<li>"), safe_text(x["kind"]), F.lit(": "), safe_text(x["note"]), F.lit("</li>"))), "").alias("notes"))
    e = events.join(notes, ["archive_id", "event_id"], "left")
    part = F.concat(F.lit('<article id="'), safe_attribute(F.col("event_id")), F.lit('"><h2>'), safe_text(F.col("role")), F.lit("</h2><pre>"), safe_text(F.col("content")), F.lit("</pre><ul>"), F.coalesce("notes", F.lit("")), F.lit("</ul></article>"))
    body = _text(e, "sequence", part, "body")
    facts = F.concat(
        F.lit("<dl><dt>Archive</dt><dd>"), F.col("archive_id").cast("string"), F.lit("</dd><dt>Capture confidence</dt><dd>"), safe_text(F.col("confidence")),
        F.lit("</dd><dt>Transcript SHA-256</dt><dd>"), safe_text(F.col("transcript_sha256")), F.lit("</dd></dl>\n"),
    )
    page = F.concat(F.lit("<h1>"), safe_text(F.col("title")), F.lit(f"</h1>\n<p>{WARNING}</p>\n"), facts, F.coalesce("body", F.lit("")))
    return archives.join(body, "archive_id", "left").select("archive_id", _page(F.col("title"), page).alias("html"))


def map_viewer(archives: DataFrame, events: DataFrame, graph: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(archive_id, html): a static page with the selection as a graph (SVG) and previews."""
    shown = map_selection(events, chosen)
    y = 60 + (F.col("rank") - 1) * 90
    dot = F.format_string('<circle cx="200" cy="%d" r="20"/><text x="240" y="%d">%s %s</text>', y, y, safe_text(F.col("event_id")), safe_text(F.col("role")))
    step = F.when(F.col("joined"), F.format_string('<path d="M 200 %d V %d"/>', y + 20, y + 70)).otherwise(F.lit(""))
    dots = _text(shown, "rank", F.concat(dot, step), "dots")
    cards = _text(shown, "rank", F.concat(F.lit("<article><h2>"), safe_text(F.col("event_id")), F.lit("</h2><pre>"), safe_text(preview(F.col("content"))), F.lit("</pre></article>")), "cards")
    at = shown.select("archive_id", "event_id", (60 + (F.col("rank") - 1) * 90).alias("y"))
    e = edges_within(only_manual(graph), shown).join(at.withColumnsRenamed({"event_id": "from_id", "y": "y1"}), ["archive_id", "from_id"]).join(at.withColumnsRenamed({"event_id": "to_id", "y": "y2"}), ["archive_id", "to_id"])
    bend = F.format_string('<path class="manual" d="M 220 %d C 420 %d, 420 %d, 220 %d"/><text x="430" y="%d">%s</text>', "y1", "y1", "y2", "y2", ((F.col("y1") + F.col("y2")) / 2).cast("int"), safe_text(F.col("kind")))
    bends = _text(e, "rank", bend, "bends")
    size = shown.groupBy("archive_id").agg((F.count("*") * 90 + 60).alias("height"))
    j = archives
    for part in (dots, cards, bends, size):
        j = j.join(part, "archive_id", "left")
    svg = F.concat(F.format_string('<svg viewBox="0 0 700 %d">', F.coalesce("height", F.lit(60))), F.coalesce("dots", F.lit("")), F.coalesce("bends", F.lit("")), F.lit("</svg>"))
    return j.select("archive_id", _page(F.col("title"), F.concat(svg, F.lit("\n"), F.coalesce("cards", F.lit("")))).alias("html"))
