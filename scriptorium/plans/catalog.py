"""The registered queries over the supplied tables.

``conversations`` are the archives: conv_id, turn, role and text.  Annotations,
manual edges and damaged copies are derived from them by fixed rules, so that
every check has something to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.html_text import page_title, parse_shared, visible_text
from ..functions.tokens import terms_of, with_nfkc
from ..model import messages_of
from ..operators import briefs, evidence, graph, index, integrity, mutations, planning, projects, search
from ..operators.canonical import canonical_sha256
from ..operators.projection import explode_messages, inspect_events, ordered_concat, project_events, render_transcripts
from ..sinks import tables
from ..sources import documents, envelopes, remote, snapshots
from ..sources import files as files_
from ..sources.markdown import markdown_messages
from ..sources.packages import manifest_violations, pack_archives, read_packages
from ..streaming.recorder import record_once
from ..workspace import Workspace
from .oracles import ORACLES

QUERY = "the and of"
PHRASE = "the of"
BUDGET = 2_000
PROMPT = 3_000
PREFIX = 100
TIME = "2024-05-01T00:00:00.000Z"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_events(_messages(spark, sf_dir))


def _index(events: DataFrame) -> DataFrame:
    return index.postings(index.event_terms(events))


def _titles(events: DataFrame) -> DataFrame:
    return events.filter("sequence = 0").select("archive_id", tx.title_of(F.col("content")).alias("title"))


def _archives(events: DataFrame) -> DataFrame:
    """(archive_id, title, transcript, transcript_sha256, event_count)."""
    made = render_transcripts(events, _titles(events)).join(_titles(events), "archive_id").join(events.groupBy("archive_id").agg(F.count("*").alias("event_count")), "archive_id")
    return made.withColumn("transcript_sha256", tx.sha256(F.col("transcript")))


def _annotations(events: DataFrame) -> DataFrame:
    """Every third event is annotated; kinds go round, notes are the first 40 characters."""
    kinds = F.array(*[F.lit(k) for k in ("decision", "important", "question", "pin")])
    a = events.filter("sequence % 3 = 0")
    return a.select("archive_id", (F.col("sequence") / 3).cast("int").alias("pos"), "event_id", F.element_at(kinds, (F.col("sequence") % 4 + 1).cast("int")).alias("kind"), F.left(tx.one_line(F.col("content")), F.lit(40)).alias("note"), F.lit(TIME).alias("created_at"))


def _edges(events: DataFrame) -> DataFrame:
    """What an assistant says answers the event before it; every fifth event also points back, which is not allowed."""
    w = Window.partitionBy("archive_id").orderBy("sequence")
    e = events.withColumn("before", F.lag("event_id").over(w)).filter("before is not null")
    answers = e.filter("role = 'assistant'").select("archive_id", F.col("before").alias("from_id"), F.col("event_id").alias("to_id"), F.lit("answers").alias("kind"))
    back = e.filter("sequence % 5 = 0").select("archive_id", F.col("event_id").alias("from_id"), F.col("before").alias("to_id"), F.lit("clarifies").alias("kind"))
    return answers.unionByName(back)


def _hits(events: DataFrame) -> DataFrame:
    return search.search_terms(events, _index(events), QUERY)


def event_projection(spark, d):
    return _events(spark, d)


def inspect(spark, d):
    return inspect_events(_events(spark, d))


def scan_search(spark, d):
    return search.search_scan(_events(spark, d), PHRASE)


def token_stats(spark, d):
    return index.term_totals(index.event_terms(_events(spark, d)))


def event_token_counts(spark, d):
    t = with_nfkc(_events(spark, d).select("archive_id", "event_id", "content"), "content", "n")
    return t.select("archive_id", "event_id", F.size(terms_of(F.col("n"))).alias("terms"))


def inverted_index(spark, d):
    i = index.term_ranks(_index(_events(spark, d)))
    return i.select("archive_id", "rank", "term", F.array_join("event_ids", " ").alias("event_ids"))


def conjunctive_search(spark, d):
    w = Window.partitionBy("archive_id").orderBy(F.col("score").desc(), "sequence")
    hits = _hits(_events(spark, d))
    return hits.withColumn("rank", F.row_number().over(w))


#: Every pair of frequent words of the texts' languages, and some queries that no search takes.
WORDS = ("the", "and", "of", "en", "de", "la", "que", "die", "der", "in")
PAIRS = [f"{a} {b}" for i, a in enumerate(WORDS) for b in WORDS[i + 1 :]]
REFUSED = ["", "a\tb", "...", "x" * 257, " ".join(f"w{i}" for i in range(17))]


def _queries(spark):
    return spark.createDataFrame(list(enumerate([*PAIRS, *REFUSED])), "query_id int, query string")


def batch_search(spark, d):
    events = _events(spark, d)
    return search.search_batch(events, _index(events), _queries(spark))


def query_checks(spark, d):
    """Queries that are refused, and for each of the others in how many events it is found."""
    events, queries = _events(spark, d), _queries(spark)
    found = search.search_batch(events, _index(events), queries).groupBy("query_id").agg(F.count("*").alias("events"))
    bad = search.query_violations(queries)
    return queries.select("query_id").join(found, "query_id", "left").join(bad.select("query_id", "rule"), "query_id", "left").select("query_id", F.coalesce("events", F.lit(0)).alias("events"), "rule")


def bucketed_search(spark, d):
    """The index and the events as bucketed tables, searched without a shuffle."""
    folder, n = tables.scratch_folder(spark), 16
    events = _events(spark, d)
    stored = tables.write_bucketed(_index(events), f"{folder}/index", n, ["term"])
    return search.search_bucketed(tables.write_bucketed(events, f"{folder}/events", n, ["sequence"]), stored, QUERY)


def top_hits(spark, d):
    return search.top_hits(_hits(_events(spark, d)), 2).select("archive_id", "event_id", "sequence", "rank")


def evidence_window(spark, d):
    events = _events(spark, d)
    anchors = search.top_hits(_hits(events), 7)
    return evidence.expand_window(anchors, events, 5)


def handoff_chain(spark, d):
    """Search, best hits, their neighbours, and a byte budget over what was found."""
    events = _events(spark, d)
    window = evidence.expand_window(search.top_hits(_hits(events), 7), events, 5)
    chosen = events.join(window.select("archive_id", "event_id"), ["archive_id", "event_id"], "left_semi")
    return evidence.head_budget(chosen, BUDGET).select("archive_id", "event_id", "sequence", "state", "allowed")


def head_budget(spark, d):
    return evidence.head_budget(_events(spark, d), BUDGET).select("archive_id", "event_id", "bytes", "before", "state", "allowed")


def head_budget_bytes(spark, d):
    return evidence.budget_bytes(evidence.head_budget(_events(spark, d), BUDGET, excerpts=True))


def raw_tail(spark, d):
    return evidence.raw_tail(_events(spark, d), BUDGET).select("archive_id", "event_id", "sequence", "part", "allowed")


def raw_tail_excerpts(spark, d):
    return evidence.raw_tail(_events(spark, d), BUDGET, excerpts=True).select("archive_id", "event_id", "excerpt")


def recent_fallback(spark, d):
    events = _events(spark, d)
    eight = evidence.last_events(events, 3).select("archive_id", "event_id", F.lit("brief").alias("purpose"))
    return eight.unionByName(evidence.last_events(events, 5).select("archive_id", "event_id", F.lit("prompt").alias("purpose")))


def evidence_union(spark, d):
    events = _events(spark, d)
    explicit = evidence.last_events(events, 2).select("archive_id", "event_id", F.col("sequence").alias("pos"))
    return evidence.evidence_union(explicit, _annotations(events), 3)


def prompt_packing(spark, d):
    p = evidence.pack_prompt(_events(spark, d), PROMPT, PREFIX)
    return p.select("archive_id", "event_id", "rank", "block_chars", "cut", F.ceil(F.col("block_chars") / 4).alias("tokens"))


def timeline_edges(spark, d):
    return graph.timeline_edges(_events(spark, d)).select("archive_id", "from_id", "to_id", "kind")


def manual_edges(spark, d):
    events = _events(spark, d)
    return graph.manual_edges(_edges(events), events).select("archive_id", "from_id", "to_id", "kind", "from_sequence", "to_sequence", "problem", "rank")


def graph_build(spark, d):
    events = _events(spark, d)
    return graph.build_graph(events, _edges(events).filter("kind = 'answers'"))


def graph_rebuild_diff(spark, d):
    """A stored graph without the timeline edges from every fourth event and with a kind changed."""
    events = _events(spark, d)
    g = graph.build_graph(events, _edges(events).filter("kind = 'answers'"))
    damaged = g.filter("not (kind = 'next' and rank % 4 = 3)")
    return graph.graph_differences(damaged, events).select("archive_id", "part", "rank", "from_id", "to_id", "kind", "side")


def role_counts(spark, d):
    return graph.role_counts(_events(spark, d))


def graph_inventory(spark, d):
    events = _events(spark, d)
    return graph.inventory(events, graph.build_graph(events, _edges(events).filter("kind = 'answers'")))


def integrity_violations(spark, d):
    """Events of which every seventh archive's second has another text and every eleventh's third another number."""
    e = _events(spark, d)
    e = e.withColumn("content", F.when((F.col("archive_id") % 7 == 0) & (F.col("sequence") == 1), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    e = e.withColumn("sequence", F.when((F.col("archive_id") % 11 == 0) & (F.col("sequence") == 2), F.lit(50)).otherwise(F.col("sequence")))
    return integrity.event_violations(e)


def annotation_orphans(spark, d):
    """Annotations of which some are moved to another archive, made empty or given another kind."""
    events = _events(spark, d)
    a = _annotations(events)
    a = a.withColumn("archive_id", F.when(F.col("archive_id") % 5 == 0, F.col("archive_id") + 1).otherwise(F.col("archive_id")))
    a = a.withColumn("note", F.when(F.col("archive_id") % 13 == 2, "").otherwise(F.col("note"))).withColumn("kind", F.when(F.col("archive_id") % 17 == 3, "other").otherwise(F.col("kind")))
    return integrity.annotation_violations(a, events, adding=True)


def index_check(spark, d):
    """A stored index without the terms of one letter, against one built anew."""
    events = _events(spark, d)
    return index.index_differences(_index(events).filter("char_length(term) > 1"), events)


def posting_violations(spark, d):
    """Postings with a stranger in every archive's term of rank 2, and rank 4 put in front."""
    i = index.term_ranks(_index(_events(spark, d)))
    bad = i.withColumn("event_ids", F.when(F.col("rank") == 2, F.array_append("event_ids", F.lit("evt_9999_000000000000"))).otherwise(F.col("event_ids")))
    bad = bad.select("archive_id", F.when(F.col("rank") == 4, F.lit(0)).otherwise(F.col("rank")).alias("pos"), "term", "event_ids")
    return integrity.index_violations(bad, _events(spark, d))


def repeated_keys(spark, d):
    return integrity.repeated(_events(spark, d), ["archive_id", "role"])


def index_payload_hash(spark, d):
    events = _events(spark, d)
    return index.index_hashes(_index(events), _archives(events))


def graph_payload_hash(spark, d):
    events = _events(spark, d)
    return graph.graph_hashes(graph.build_graph(events, _edges(events).filter("kind = 'answers'")), events, _archives(events))


def recorder_caps(spark, d):
    return integrity.recorder_caps(_messages(spark, d), 1_000, 5, 2_500).select("archive_id", "sequence", "bytes", "total_messages", "total_bytes", "accepted")


def recorder_stream(spark, d):
    """Messages in no order, recorded by a stream in three micro-batches."""
    folder = tables.scratch_folder(spark)
    _messages(spark, d).repartition(F.xxhash64("archive_id", "sequence")).write.parquet(f"{folder}/in")
    return record_once(spark, f"{folder}/in", f"{folder}/out", 3, max_message=1_000, max_messages=5, max_bytes=2_500).select("archive_id", "sequence", "accepted", "reason")


def titles(spark, d):
    return _titles(_events(spark, d)).withColumn("valid", tx.is_valid_title(F.col("title")))


def transcript_render(spark, d):
    events = _events(spark, d)
    return render_transcripts(events, _titles(events))


def fence_closing(spark, d):
    """Content given a fence at its start and, in every other event, one at its end."""
    e = _events(spark, d)
    c = F.concat(F.lit("```py\n"), F.col("content"), F.when(F.col("sequence") % 2 == 0, "\n```").otherwise("\n~~~"))
    return e.select("archive_id", "event_id", tx.close_fence(c).alias("content"))


def viewer_escape(spark, d):
    e = _events(spark, d).withColumn("content", F.concat(F.lit("<b>\"'&\u0001"), "content"))
    return e.select("archive_id", "event_id", tx.safe_text(tx.preview(F.col("content"), 100)).alias("shown"), tx.safe_line(F.col("content")).alias("line"))


def viewer_selection(spark, d):
    events = _events(spark, d)
    return briefs.map_selection(events, None, 3).select("archive_id", "event_id", "sequence", "rank", "joined")


def map_edges(spark, d):
    events = _events(spark, d)
    g = graph.build_graph(events, _edges(events).filter("kind = 'answers'"))
    return briefs.edges_within(graph.only_manual(g), briefs.map_selection(events, None, 3)).select("archive_id", "from_id", "to_id", "kind")


def annotation_groups(spark, d):
    events = _events(spark, d)
    return briefs.annotation_groups(events.select("archive_id").distinct(), _annotations(events))


def continuation_evidence(spark, d):
    events = _events(spark, d)
    packet = evidence.evidence_union(evidence.last_events(events, 1).select("archive_id", "event_id", F.lit(0).alias("pos")), _annotations(events))
    chosen = events.join(packet, ["archive_id", "event_id"])
    return evidence.head_budget(chosen, BUDGET, order="rank").select("archive_id", "event_id", "rank", "state", "allowed")


def handoff_evaluation(spark, d):
    """Bytes of the chosen evidence, and of the newest messages within the same bytes."""
    events = _events(spark, d)
    window = evidence.expand_window(search.top_hits(_hits(events), 7), events, 5)
    chosen = events.join(window.select("archive_id", "event_id"), ["archive_id", "event_id"], "left_semi")
    return planning.evaluation_summary(chosen, events, BUDGET)


def project_search(spark, d):
    """Hits in archives 0 to 9 of each project of ten, by title, then place."""
    events = _events(spark, d)
    members = events.select((F.col("archive_id") / 10).cast("long").alias("project_id"), "archive_id").distinct()
    return projects.search_projects(members, _titles(events), search.search_scan(events, PHRASE)).select("project_id", "archive_id", "event_id", "sequence")


def project_verify(spark, d):
    """Members whose stored transcript hash is that of now; every ninth archive has changed."""
    events = _events(spark, d)
    a = _archives(events)
    now = a.select("archive_id", "transcript_sha256")
    stored = a.select((F.col("archive_id") / 10).cast("long").alias("project_id"), "archive_id", F.when(F.col("archive_id") % 9 == 0, F.reverse("transcript_sha256")).otherwise(F.col("transcript_sha256")).alias("transcript_sha256"))
    return projects.verify_members(stored, now)


def nfkc_tokens(spark, d):
    e = _events(spark, d).withColumn("content", F.concat(F.lit("ﬁne Ａ２ ① "), "content"))
    return index.term_totals(index.event_terms(e))


def html_visible_text(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", visible_text("html").alias("text"))


def page_titles(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", page_title("html").alias("title"))


def markdown_events(spark, d):
    """Documents as Markdown transcripts, with a heading before and in the middle."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    t = docs.select(F.col("doc_id").alias("archive_id"), F.concat(F.lit("# A title\n\n## User\n\n"), "text", F.lit("\n\n## Assistant \n\n\nyes\n")).alias("transcript"))
    return project_events(markdown_messages(t))


def canonical_hash(spark, d):
    e = _events(spark, d).select("archive_id", F.to_json(F.struct("role", "event_id", "content")).alias("raw"), "event_id")
    return e.select("archive_id", "event_id", canonical_sha256("raw").alias("sha256"))


def zip_roundtrip(spark, d):
    events = _events(spark, d)
    files = events.select("archive_id", F.concat(F.lit("events/"), "event_id", F.lit(".md")).alias("name"), F.encode("content", "UTF-8").alias("data"))
    return read_packages(pack_archives(files)).select("archive_id", "name", F.sha2("data", 256).alias("sha256"))


def canonical_order(spark, d):
    """Events of each archive joined into one text, as every ordered text is made."""
    return ordered_concat(_events(spark, d), ["archive_id"], "sequence", "event_id", "ids", " ")


def shared_page_roundtrip(spark, d):
    """Conversations written as pages with authors' roles, and read back."""
    m = _messages(spark, d).filter("role in ('user', 'assistant')")
    part = F.concat(F.lit('<article data-message-author-role="'), "role", F.lit('"><div><p>'), tx.escape_html(F.col("content")), F.lit("</p></div></article>"))
    pages = ordered_concat(m.withColumn("t", part), ["archive_id"], "sequence", "t", "html")
    parsed = pages.select("archive_id", parse_shared("html").alias("p"))
    return project_events(parsed.select("archive_id", F.posexplode("p.messages").alias("sequence", "m")).select("archive_id", "sequence", "m.role", "m.content"))


def _stored(df):
    """A table written down, as documents are before they are checked; checks read them several times."""
    folder = tables.scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _documents(events):
    """Archives made from normalised imports, as JSON documents."""
    messages = events.groupBy("archive_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    a = _archives(events).join(messages, "archive_id").select("*", F.lit(TIME).alias("created_at"), F.lit("conversations").alias("source_name"), F.col("transcript_sha256").alias("source_sha256"))
    return _stored(documents.archive_documents(a, events))


def archive_roundtrip(spark, d):
    """Archives written as JSON documents, checked as a whole and read back."""
    texts = _documents(_events(spark, d))
    bad = documents.archive_text_violations(texts).select("archive_id").distinct()
    _, again = documents.parse_archives(texts.join(bad, "archive_id", "left_anti"))
    return again.select("archive_id", "event_id", "sequence", "role", "content_sha256")


def archive_forgeries(spark, d):
    """Archive documents forged so that hashes and lengths still fit: texts, keys, sources, captures and the order of events."""
    texts = _documents(_events(spark, d)).withColumn("d", F.from_json("raw", documents.ARCHIVE))
    at = lambda *r: (F.col("archive_id") % 11).isin(*r)
    doc, more = F.col("d"), F.lit("x")
    script = F.when(at(1), F.concat(doc["transcript"]["content"], more)).otherwise(doc["transcript"]["content"])
    transcript = F.struct(F.lit("utf-8").alias("encoding"), F.octet_length(script).cast("long").alias("byteLength"), tx.sha256(script).alias("sha256"), script.alias("content"))
    message = lambda m, i: F.struct(F.when(at(8) & (i == 0), "robot").otherwise(m["role"]).alias("role"), F.when(at(7) & (i == 0), more).otherwise(m["content"]).alias("content"), F.when(at(9) & (i == 1), more).alias("more"))
    source = F.struct(F.when(at(8), "other/1").otherwise("import/1").alias("schema"), doc["normalizedSource"]["title"].alias("title"), F.transform(doc["normalizedSource"]["messages"], message).alias("messages"), F.when(at(4), more).alias("more"))
    as_shared = {"method": "public_shared_link", "confidence": "visible_snapshot", "provider": "chatgpt", "capture_method": "public_shared_link", "completeness": "visible_snapshot", "hidden_state_available": False, "source_url_sha256": "0" * 64, "source_html_sha256": "1" * 64, "parser": "dom"}
    own = lambda f: F.when(~at(5, 6), doc["capture"][f]) if f in documents.CAPTURE_FIELDS["normalized_json"] else F.lit(None)
    # fields that are null are not written
    capture = F.struct(*[F.coalesce(own(f), F.when(at(5, 6), F.lit(as_shared.get(f)))).alias(f) for f in {**dict.fromkeys(documents.CAPTURE_FIELDS["normalized_json"]), **as_shared}])
    events = F.when(at(10), F.reverse(doc["events"])).otherwise(doc["events"])
    events = F.transform(events, lambda e, i: e.withField("more", F.when(at(3) & (i == 0), more)))
    forged = F.struct(
        doc["schema"].alias("schema"), doc["archiveId"].alias("archiveId"), doc["createdAt"].alias("createdAt"), F.when(at(2), more).otherwise(doc["title"]).alias("title"), capture.alias("capture"),
        doc["security"].withField("more", F.when(at(3), more)).alias("security"), transcript.alias("transcript"), events.alias("events"), F.when(~at(6), source).alias("normalizedSource"),
    )
    return documents.archive_text_violations(_stored(texts.select("archive_id", F.to_json(forged).alias("raw"))))


def registry_checks(spark, d):
    """A registry of adapters for each ten archives, an adapter for each, some with faults and some twice."""
    a = F.col("archive_id")
    at = lambda n, r: a % n == r
    m = _events(spark, d).select("archive_id").distinct()
    manifest = F.struct(
        F.lit("adapter/1").alias("schema"), F.concat(F.when(at(8, 5), "X").otherwise("a"), F.when(at(7, 3), a - 1).otherwise(a)).alias("id"), F.when(at(9, 2), "").otherwise("N").alias("name"), F.when(at(6, 1), "1.0").otherwise("1.0.0-rc.1").alias("version"),
        F.when(at(5, 4), "html").otherwise("json").alias("inputFormat"), F.when(at(11, 6), F.array(F.lit("normalize-only"), F.lit("run"))).otherwise(F.array(F.lit("normalize-only"))).alias("capabilities"), F.when(~at(13, 8), "s").alias("securityContact"), F.when(at(10, 7), 1).alias("more"),
    )
    listed = m.groupBy((a / 10).cast("long").alias("p")).agg(F.sort_array(F.collect_list(manifest)).alias("adapters"))
    raw = F.to_json(F.struct(F.lit("registry/1").alias("schema"), "adapters"))
    return documents.parse_registries(listed.select(F.col("p").alias("archive_id"), raw.alias("raw")), "json")[1]


def bundle_files(spark, d):
    """Bundles written and read back: hashes of the texts, and whether the checksums and the archive document hold."""
    events, folder = _events(spark, d), tables.scratch_folder(spark)
    tables.write_bundles(_documents(events), _archives(events), folder)
    files = spark.read.parquet(folder)
    listed = tables.checksums(files).select("archive_id", F.explode(F.from_json("checksums", "map<string,string>")).alias("name", "listed"))
    bad = documents.archive_text_violations(files.filter("name = 'archive.json'").select("archive_id", F.col("content").alias("raw"))).select("archive_id").distinct().withColumn("_bad", F.lit(True))
    j = files.join(listed, ["archive_id", "name"], "full_outer").join(bad, "archive_id", "left")
    text = F.col("name") != "archive.json"
    return j.select("archive_id", "name", F.when(text, tx.sha256(F.col("content"))).alias("sha256"), F.col("listed").eqNullSafe(tx.sha256(F.col("content"))).alias("listed"), F.col("_bad").isNull().alias("sound"))


def file_texts(spark, d):
    """Transcripts as files, read as texts and as artifacts by their paths; a folder for each few thousand files, so the driver holds few names."""
    folder, a = tables.scratch_folder(spark), _archives(_events(spark, d))
    text = F.when(F.col("archive_id") % 6 == 1, "").otherwise(F.col("title"))
    parts = -(-_messages(spark, d).select("archive_id").distinct().count() // files_.FILES_AT_ONCE) or 1
    a.select("archive_id", text.alias("value"), F.pmod(F.xxhash64("archive_id"), F.lit(parts)).alias("part")).write.partitionBy("part").parquet(f"{folder}/made")
    made = spark.read.parquet(f"{folder}/made").repartition(spark.sparkContext.defaultParallelism, "archive_id")

    def paths():
        for p in sorted(r.part for r in made.select("part").distinct().collect()):
            # tasks put their files in place themselves; the driver would move them one by one
            out = made.filter(F.col("part") == p).select("archive_id", "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
            out.partitionBy("archive_id").option("lineSep", "|").text(f"{folder}/files/part={p}")
            yield f"{folder}/files/part={p}/*/*.txt"

    read = files_.file_table(spark, paths(), f"{folder}/read")
    of = F.regexp_extract("path", "archive_id=([0-9]+)/", 1).cast("long").alias("archive_id")
    found = files_.artifacts_of(read, f"{folder}/files").select(of, "sha256", F.col("path").rlike("^part=[0-9]+/archive_id=").alias("below"))
    return documents.texts_of(read).select(of, "raw", "problem").join(found, "archive_id")


def workspace_tables(spark, d):
    """A workspace with a graph and an annotation added in turn: the graph, and what its other tables hold."""
    w = Workspace(spark, tables.scratch_folder(spark))
    w._write("events", _events(spark, d))
    w.build_graph()
    first = w.table("events").filter("sequence = 0").select("archive_id", "event_id", F.lit("pin").alias("kind"), F.lit("n").alias("note"), F.lit(TIME).alias("created_at"))
    w.annotate(first)
    w.annotate(first.filter("archive_id % 2 = 0"))
    rows = w.table("graph").select(F.lit("graph").alias("part"), "archive_id", F.concat_ws(" ", "from_id", "to_id", "kind").alias("what"))
    notes = w.table("annotations").select(F.lit("annotations").alias("part"), "archive_id", F.concat_ws(" ", "pos", "event_id").alias("what"))
    empty = w.table("claims").select(F.lit("claims").alias("part"), "archive_id", F.col("claim_id").alias("what"))
    return integrity.union_all([rows, notes, empty, w.verify_graph().select(F.lit("differs").alias("part"), "archive_id", F.col("kind").alias("what"))])


def sidecar_checks(spark, d):
    """Sidecars of archives as files, of which some are missing, empty, cut off, another's or stray, with annotations of which some are unsound."""
    events = _events(spark, d)
    a, folder = F.col("archive_id"), tables.scratch_folder(spark)
    at = lambda n, r: a % n == r
    item = F.struct(F.when(at(10, 4) & (F.col("pos") == 0), "evt_0").otherwise(F.col("event_id")).alias("eventId"), F.when(at(6, 3), "odd").otherwise(F.col("kind")).alias("kind"), "note", F.col("created_at").alias("createdAt"))
    items = _annotations(events).groupBy("archive_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"]).alias("items"))
    own = F.when(at(7, 5), documents.stored_id(a + 1)).otherwise(documents.stored_id(a))
    text = F.to_json(F.struct(F.lit("annotations/1").alias("schema"), own.alias("archiveId"), "items", F.when(at(9, 8), "x").alias("more")))
    raw = F.when(at(5, 1), " ").when(at(5, 2), F.left("text", F.lit(40))).otherwise(F.col("text"))
    files = items.withColumn("text", text).filter(~at(5, 0)).select(F.when(at(11, 4), -a).otherwise(a).alias("of"), raw.alias("value"))
    files.write.partitionBy("of").text(folder)
    found = documents.load_sidecars(spark, f"{folder}/*/*.txt", F.regexp_extract("_path", "/of=(-?[0-9]+)/", 1).cast("long"))
    archives = events.select(a.alias("key"), "archive_id", documents.stored_id(a).alias("stored_id")).distinct()
    states = documents.sidecar_states(archives, found)
    notes, bad = documents.read_annotations(states, events)
    told = states.select(F.lit("state").alias("part"), "archive_id", F.col("state").alias("what"), F.lit(None).cast("string").alias("subject"))
    broken = bad.select(F.lit("rule").alias("part"), "archive_id", F.col("rule").alias("what"), F.when(~F.col("rule").startswith("sidecar"), F.col("subject")).alias("subject"))
    return integrity.union_all([told, broken, notes.select(F.lit("note").alias("part"), "archive_id", F.col("event_id").alias("what"), F.col("pos").cast("string").alias("subject"))])


def envelope_roundtrip(spark, d):
    """Transcripts encrypted and decrypted."""
    a = _archives(_events(spark, d)).select("archive_id", F.encode("transcript", "UTF-8").alias("content"))
    return envelopes.decrypt(envelopes.encrypt(a, b"a phrase for this query"), b"a phrase for this query").select("archive_id", F.sha2("content", 256).alias("sha256"), "error")


def continuation_packets(spark, d):
    events = _events(spark, d)
    return planning.continuation_packets(_archives(events).withColumn("confidence", F.lit("user_supplied")), events, _annotations(events), budget=BUDGET).select("archive_id", "event_ids")


def handoffs(spark, d):
    events = _events(spark, d)
    return planning.handoffs(planning.continuation_packets(_archives(events).withColumn("confidence", F.lit("user_supplied")), events, _annotations(events)))


def conversation_briefs(spark, d):
    events = _events(spark, d)
    g = graph.build_graph(events, _edges(events).filter("kind = 'answers'"))
    return briefs.brief(_archives(events).withColumn("confidence", F.lit("user_supplied")), events, _annotations(events), g)


def viewer_pages(spark, d):
    events = _events(spark, d)
    return briefs.viewer(_archives(events).withColumn("confidence", F.lit("user_supplied")), events, _annotations(events))


def map_pages(spark, d):
    events = _events(spark, d)
    g = graph.build_graph(events, _edges(events).filter("kind = 'answers'"))
    return briefs.map_viewer(_archives(events), events, g)


def prompt_plans(spark, d):
    events = _events(spark, d)
    p = planning.prompt_plans(_archives(events), events, "ollama", "a-model", "semantic", PHRASE, PROMPT, 512)
    return planning.plan_summaries(p).select("archive_id", F.array_join("events_included", " ").alias("events"), "input_chars", "estimated_tokens", "over_limit")


def plan_check(spark, d):
    """Plans of which every seventh archive's prompt and every fifth's size have been changed."""
    events = _events(spark, d)
    p = planning.prompt_plans(_archives(events), events, "ollama", "a-model", "summary", None, PROMPT, 512)
    p = p.filter("not over_limit").withColumn("prompt", F.when(F.col("archive_id") % 7 == 0, F.concat(F.expr("substring(prompt, 1, length(prompt) - 1)"), F.lit("\u0021\u0021"))).otherwise(F.col("prompt")))
    p = p.withColumn("input_chars", F.when(F.col("archive_id") % 5 == 0, F.col("input_chars") + 1).otherwise(F.col("input_chars")))
    return planning.plan_violations(p, PROMPT, 512).select("archive_id", "rule")


def _json(c):
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def stream_pages(spark, d):
    """Conversations written as router streams, flat graphs of strings and references, and read back."""
    w = Window.partitionBy("archive_id").orderBy("sequence")
    m = _messages(spark, d).withColumn("b", 13 + 8 * (F.row_number().over(w) - 1))
    entries = F.format_string(
        '{"_5":%d},{"_6":%d,"_7":%d,"_9":%d},"m%d",{"_8":%d},%s,{"_10":11,"_12":%d},[%d],%s',
        F.col("b") + 1, F.col("b") + 2, F.col("b") + 3, F.col("b") + 5, F.col("b"), F.col("b") + 4, _json(F.col("role")), F.col("b") + 6, F.col("b") + 7, _json(F.col("content")),
    )
    m = m.withColumn("t", entries).withColumn("at", F.col("b").cast("string"))
    graphs = ordered_concat(m, ["archive_id"], "sequence", "t", "nodes", ",").join(ordered_concat(m, ["archive_id"], "sequence", "at", "line", ","), "archive_id")
    flat = F.concat(F.lit('[{"_1":2},"data",{"_3":4},"linear_conversation",['), "line", F.lit('],"message","id","author","role","content","content_type","text","parts",'), "nodes", F.lit("]"))
    page = F.concat(F.lit("<title>T</title><script>window.__reactRouterContext.streamController.enqueue("), _json(flat), F.lit(");</script>"))
    parsed = graphs.select("archive_id", parse_shared(page).alias("p"))
    rows = parsed.select("archive_id", "p.parser", F.posexplode("p.messages").alias("sequence", "m"))
    return project_events(rows.select("archive_id", "sequence", "m.role", "m.content")).join(rows.select("archive_id", "sequence", "parser"), ["archive_id", "sequence"])


def _snapshots(spark, d):
    """Pages with their metadata, of which some were cut, are by a stranger or have another hash."""
    m = _messages(spark, d).filter("role in ('user', 'assistant')")
    part = F.concat(F.lit('<article data-message-author-role="'), "role", F.lit('"><div><p>'), tx.escape_html(F.col("content")), F.lit("</p></div></article>"))
    pages = ordered_concat(m.withColumn("t", part), ["archive_id"], "sequence", "t", "html")
    damaged = lambda n, r: F.col("archive_id") % n == r
    digest = tx.sha256(F.col("html"))
    meta = F.to_json(F.struct(
        F.lit("shared-snapshot/0.1").alias("schema"), F.when(damaged(7, 1), "stranger").otherwise("chatgpt").alias("provider"), F.lit(TIME).alias("capturedAt"), tx.sha256(F.lit("u")).alias("sourceUrlSha256"),
        F.when(damaged(9, 2), F.reverse(digest)).otherwise(digest).alias("pageSha256"), F.octet_length("html").alias("byteLength"), F.lit("none").alias("parser"), F.lit("w").alias("warning"), F.when(damaged(11, 3), "x").alias("more"),
    ))
    return pages.select("archive_id", F.encode(F.when(damaged(5, 0), F.concat("html", F.lit(" "))).otherwise(F.col("html")), "UTF-8").alias("html_bytes"), meta.alias("meta"))


def snapshot_checks(spark, d):
    return snapshots.snapshot_violations(_snapshots(spark, d))


def snapshot_events(spark, d):
    _, events, _ = snapshots.import_snapshots(_snapshots(spark, d))
    return events


def _imports(spark, d, damaged):
    """Conversations as normalised imports; damaged ones lack a title or messages, or have other roles, keys or schemas."""
    events = _events(spark, d)
    at = lambda n, r: (F.col("archive_id") % n == r) if damaged else F.lit(False)
    events = events.withColumn("role", F.when(at(11, 2) & (F.col("sequence") == 0), "robot").otherwise(F.col("role"))).withColumn("name", F.when(at(17, 4) & (F.col("sequence") == 1), "x"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("sequence", "role", "content", "name"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["name"].alias("name")))
    rows = events.groupBy("archive_id").agg(listed.alias("messages")).join(_titles(_events(spark, d)), "archive_id")
    messages = F.when(at(13, 3), F.slice("messages", 1, 0)).otherwise(F.col("messages"))
    doc = F.struct(F.when(at(19, 5), "other/1").otherwise("import/1").alias("schema"), F.when(at(7, 0), "").otherwise(F.col("title")).alias("title"), messages.alias("messages"), F.when(at(5, 1), "x").alias("more"))
    return rows.select("archive_id", F.to_json(doc).alias("raw"))


def import_checks(spark, d):
    return documents.parse_imports(_imports(spark, d, True), "import/1")[1]


def import_events(spark, d):
    imports, _ = documents.parse_imports(_imports(spark, d, False), "import/1")
    return project_events(explode_messages(imports))


def _members(events):
    return events.select((F.col("archive_id") / 10).cast("long").alias("project_id"), "archive_id").distinct()


def project_checks(spark, d):
    """Projects of ten archives with repeats, strangers, loops and unknown kinds."""
    members = _members(_events(spark, d))
    artifacts = members.select("project_id", F.concat(F.lit("file-"), "project_id").alias("artifact_id")).distinct()
    a = F.col("archive_id")
    edges = members.select("project_id", a, a.cast("string").alias("from_id"), F.when(a % 7 == 0, a).otherwise(a + 1).cast("string").alias("to_id"), F.when(a % 11 == 0, "other").when(a % 6 == 5, "related").otherwise("continues").alias("kind"))
    claims = members.select(F.when(a % 9 == 0, F.col("project_id") + 1).otherwise(F.col("project_id")).alias("project_id"), F.concat(F.lit("c"), a).alias("claim_id"), "archive_id", F.when(a % 8 == 0, "guess").otherwise("decision").alias("kind"), F.when(a % 12 == 0, "").otherwise("n").alias("note"))
    again = lambda df, n: df.unionByName(df.filter(a % n == 0))
    return projects.project_violations(again(members, 13), artifacts, again(edges, 17), claims, id_formats=False)


def project_forgeries(spark, d):
    """Projects of ten archives as JSON documents, with faults in the fields of every part."""
    events = _events(spark, d)
    first = events.filter("sequence = 0").select((F.col("archive_id") / 10).cast("long").alias("p"), F.col("archive_id").alias("a"), "event_id", tx.sha256(F.col("archive_id").cast("string")).alias("h"))
    a, h = F.col("a"), F.col("h")
    at = lambda n, r: a % n == r
    named = lambda prefix, digest: F.concat(F.lit(prefix), F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 27))
    member = named("arc_", h)
    parts = first.select(
        "p",
        F.struct(F.when(at(23, 4), "arc_x").otherwise(member).alias("id"), F.when(at(7, 1), "../a").when(at(7, 2), "/a").otherwise(F.concat(F.lit("archives/"), a)).alias("path"), F.when(at(9, 3), F.concat(a, F.lit("\n"))).when(at(9, 4), "").otherwise("T").alias("title"),
                 F.when(at(11, 5), F.upper(h)).otherwise(h).alias("transcriptSha256"), F.when(~at(13, 6), h).alias("archiveSha256"), F.when(at(17, 7), "x").alias("more")).alias("archive"),
        F.struct(F.when(at(10, 9), "art_y").otherwise(named("art_", h)).alias("id"), F.when(at(5, 1), "link").when(at(2, 0), "file").otherwise("repository").alias("kind"), F.lit("d/f").alias("path"), F.when(at(8, 2), F.repeat(F.lit("n"), F.lit(161))).otherwise("n").alias("name"),
                 F.when(at(2, 0), F.when(~at(3, 2), h)).alias("sha256"), F.when(at(2, 1), F.when(at(3, 1), F.left(h, F.lit(39))).otherwise(F.left(h, F.lit(40)))).alias("head")).alias("artifact"),
        F.struct(member.alias("from"), F.when(at(7, 0), member).otherwise(named("art_", h)).alias("to"), F.when(at(6, 1), "other").when(at(6, 2), "related").otherwise("supports").alias("kind")).alias("edge"),
        F.struct(named("clm_", F.when(at(4, 3), tx.sha256((a - 1).cast("string"))).otherwise(h)).alias("id"), member.alias("archiveId"), F.when(at(5, 2), F.substring("event_id", 1, 20)).otherwise(F.col("event_id")).alias("eventId"), F.when(at(6, 5), "guess").otherwise("task").alias("kind"),
                 F.when(at(7, 6), "\t").otherwise("n").alias("note"), F.when(at(8, 7), "yesterday").otherwise(TIME).alias("createdAt")).alias("claim"),
    )
    listed = parts.groupBy("p").agg(*[F.sort_array(F.collect_list(c)).alias(f"{c}s") for c in ("archive", "artifact", "edge", "claim")])
    p = F.col("p")
    doc = F.struct(
        F.when(p % 3 == 1, "other/1").otherwise(documents.PROJECT_SCHEMA).alias("schema"), named("prj_", tx.sha256(p.cast("string"))).alias("projectId"), F.when(p % 4 == 2, "").otherwise("P").alias("name"), F.when(p % 5 != 3, TIME).alias("createdAt"),
        "archives", "artifacts", "edges", "claims",
    )
    return documents.project_text_violations(_stored(listed.select(p.alias("archive_id"), F.to_json(doc).alias("raw"))))


def mutation_batch(spark, d):
    """One ordered batch for all archives, with repeats, strangers and too many of a kind; its verdicts, and what is stored after it."""
    events = _events(spark, d)
    w = Workspace(spark, tables.scratch_folder(spark))
    w._write("archives", _archives(events))
    w._write("events", events)
    a, p, n = F.col("archive_id"), F.col("project_id"), F.col("sequence")
    first = events.filter("sequence = 0").withColumn("project_id", (a / 10).cast("long"))

    def ops(op, place, rows, **fields):
        fields = {"project_id": p.cast("string"), "archive_id": a} | fields
        return rows.select(F.lit(op).alias("op"), (F.lit(place * 10**15) + a * 10**6 + n).alias("seq"), *[(v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in fields.items()])

    again = lambda rows, of, r: rows.unionByName(rows.filter(a % of == r).withColumn("sequence", F.lit(1)))
    after, turned = (a + F.when(a % 8 == 0, 0).otherwise(1)).cast("string"), a % 6 == 2
    here = a.cast("string")
    parts = [
        ops("project", 1, first.filter("archive_id % 10 = 0"), name=F.when(p % 7 != 3, "P").otherwise(""), created_at=TIME),
        ops("edge", 2, first.filter("archive_id % 11 = 2"), from_id=here, to_id=after, kind="continues"),
        ops("member", 3, again(first, 4, 1)),
        ops("member", 4, first.filter("archive_id % 13 = 5"), archive_id=-a - 1),
        ops("edge", 5, first, from_id=F.when(turned, after).otherwise(here), to_id=F.when(turned, here).otherwise(after), kind=F.when(turned, "related").when(a % 6 == 1, "other").otherwise("continues")),
        ops("claim", 6, again(first, 5, 2), id=F.concat(F.lit("c"), a), event_id=F.when(a % 7 == 2, "evt_0").otherwise(F.col("event_id")), kind=F.when(a % 9 == 4, "guess").otherwise("task"), note="n"),
        ops("annotation", 7, events.withColumn("project_id", F.lit(None)), event_id=F.col("event_id"), kind="pin", note=F.when(n % 4 == 2, "").otherwise("n"), created_at=TIME),
        ops("erase", 8, first.filter("archive_id % 17 = 3")),
    ]
    fields = [c.split() for c in mutations.BATCH.split(", ")]
    batch = _stored(integrity.union_all([x.select(*[(F.col(c) if c in x.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields]) for x in parts]))
    verdicts = w.apply(batch, mutations.Caps(members=8, annotations=3)).select(F.lit("verdict").alias("part"), "op", F.col("seq").cast("string").alias("key"), "rule")
    stored = lambda name, op, *keys: w.table(name).select(F.lit("stored").alias("part"), F.lit(op).alias("op"), F.concat_ws("/", *keys).alias("key"), F.lit(None).cast("string").alias("rule"))
    return integrity.union_all([
        verdicts, stored("projects", "project", "project_id"), stored("members", "member", "project_id", "archive_id", "transcript_sha256"), stored("edges", "edge", "project_id", "from_id", "to_id", "kind"),
        stored("claims", "claim", "project_id", "claim_id", "event_id"), stored("annotations", "annotation", "archive_id", "pos", "event_id"),
    ])


def claims_verify(spark, d):
    """Claims of which some are about archives that have changed or events that are not there."""
    events = _events(spark, d)
    members = _members(events).withColumn("valid", F.col("archive_id") % 9 != 0)
    claims = events.filter("sequence < 3").select((F.col("archive_id") / 10).cast("long").alias("project_id"), "archive_id", F.concat("archive_id", F.lit("/"), "sequence").alias("claim_id"), F.when(F.col("archive_id") % 5 == 0, F.reverse("event_id")).otherwise(F.col("event_id")).alias("event_id"))
    return projects.verify_claims(claims, members, events)


def project_handoffs(spark, d):
    """Claims, links and first hits of each project as Markdown."""
    events = _events(spark, d)
    members = _members(events)
    claims = _annotations(events).join(members, "archive_id").withColumn("claim_id", F.format_string("%08d-%05d", "archive_id", "pos"))
    edges = members.select("project_id", F.col("archive_id").cast("string").alias("from_id"), (F.col("archive_id") + 1).cast("string").alias("to_id"), F.lit("continues").alias("kind"))
    titles_ = events.select("archive_id", F.format_string("archive %08d", "archive_id").alias("title")).distinct()
    hits = projects.search_projects(members, titles_, search.search_scan(events, PHRASE))
    named = members.select("project_id", F.concat(F.lit("number "), "project_id").alias("name")).distinct()
    return projects.project_handoff(named, claims, edges, hits, 5)


def project_members(spark, d):
    """Members of projects written as JSON documents and read back."""
    members = _members(_events(spark, d))
    entry = F.struct(F.concat(F.lit("a"), F.format_string("%08d", "archive_id")).alias("id"), F.concat(F.lit("archives/"), "archive_id").alias("path"))
    texts = members.groupBy(F.col("project_id").alias("archive_id")).agg(F.sort_array(F.collect_list(entry)).alias("archives"))
    raw = F.to_json(F.struct(F.lit("project/1").alias("schema"), F.concat(F.lit("p"), "archive_id").alias("projectId"), F.lit("n").alias("name"), F.lit(TIME).alias("createdAt"), "archives"))
    return documents.parse_projects(texts.select("archive_id", raw.alias("raw")))["members"].select("project_id", "archive_id", "path")


def package_checks(spark, d):
    """Packages against manifests with a hash changed, an entry left out or one too many."""
    events = _events(spark, d)
    path = F.concat(F.lit("events/"), "event_id", F.lit(".md"))
    files = read_packages(pack_archives(events.select("archive_id", path.alias("name"), F.encode("content", "UTF-8").alias("data"))))
    damaged = (F.col("archive_id") % 7 == 0) & (F.col("sequence") == 1)
    listed = events.filter("not (archive_id % 5 = 0 and sequence = 2)").select("archive_id", path.alias("path"), F.octet_length("content").alias("byteLength"), F.when(damaged, F.reverse("content_sha256")).otherwise(F.col("content_sha256")).alias("sha256"))
    more = events.filter("archive_id % 11 = 0 and sequence = 0").select("archive_id", F.lit("more.md").alias("path"), F.lit(1).alias("byteLength"), "content_sha256")
    return manifest_violations(files, listed.unionByName(more.withColumnRenamed("content_sha256", "sha256")))


def linked_graphs(spark, d):
    """A graph to which links over two events are added."""
    events = _events(spark, d)
    w = Window.partitionBy("archive_id").orderBy("sequence")
    more = events.select("archive_id", F.col("event_id").alias("from_id"), F.lead("event_id", 2).over(w).alias("to_id"), F.lit("supports").alias("kind")).filter("to_id is not null")
    return graph.link_events(graph.build_graph(events, _edges(events).filter("kind = 'answers'")), events, more)


def share_urls(spark, d):
    """Urls of pages, some of them as shared conversations have them, with ports, queries or without encryption."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    forms = ("https://chatgpt.com/share/%d", "https://g.co/gemini/share/%d", "http://chatgpt.com/share/%d", "https://chatgpt.com:444/share/%d", "https://claude.ai/share/%d?y=1", "https://claude.ai/share/%d")
    url = F.element_at(F.array(*[F.format_string(f, "page_id") for f in forms], F.col("url")), (F.col("page_id") % 7 + 1).cast("int"))
    return p.select("page_id", snapshots.share_provider(url).alias("provider"))


def _serve(url, timeout, row):
    """Answers for a page's url out of the table's row, by what its path says."""
    what, hops = url.rsplit("/", 2)[-2:]
    page = {"content-type": "text/html; charset=utf-8"}
    if int(hops):
        return remote.Answer(302, {"location": f"{int(hops) - 1}"}, iter(()))
    if what == "lost":
        raise OSError("no route")
    kinds = {
        "stranger": (301, {"location": "https://example.com/share/x"}, b""), "nowhere": (307, {}, b""), "gone": (404, page, b"gone"), "text": (200, {"content-type": "text/plain"}, b"x"),
        "large": (200, page | {"content-length": str(remote.MAX_PAGE_BYTES + 1)}, b""), "bytes": (200, page, b"\xff\xfe"),
    }
    status, headers, body = kinds.get(what, (200, page, row["html"].encode()))
    return remote.Answer(status, headers, iter([body]))


def fetched_pages(spark, d):
    """Pages served from the table under urls that redirect, lead astray, are gone or are no pages."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    kinds = ("page", "stranger", "nowhere", "gone", "text", "large", "bytes", "lost")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("page_id") % 8 + 1).cast("int"))
    url = F.concat(F.when(F.col("page_id") % 9 == 4, "http").otherwise("https"), F.lit("://chatgpt.com/share/"), kind, F.lit("/"), (F.col("page_id") % 5).cast("string"))
    got = remote.fetch_pages(p.select(F.col("page_id").alias("archive_id"), url.alias("url"), "html"), _serve)
    named = remote.snapshots_of(got, TIME).select("archive_id", "name")
    return got.select("archive_id", "provider", "source_url_sha256", "source_html_sha256", "byte_length", "error").join(named, "archive_id", "left")


def artifact_paths(spark, d):
    """Paths of urls, whole and without their first character."""
    p = spark.read.parquet(f"{d}/pages.parquet").withColumn("path", F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1))
    path = F.when(F.col("page_id") % 3 == 0, F.col("path")).when(F.col("page_id") % 3 == 1, F.concat(F.lit(".."), "path")).otherwise(F.substr("path", F.lit(2)))
    return p.select("page_id", files_.is_relative_path(path).alias("relative"))


def unsafe_texts(spark, d):
    """Content with a bell, a tab or a line feed at the end of some."""
    mark = F.element_at(F.array(F.lit("\a"), F.lit("\t"), F.lit("\n"), F.lit("")), (F.col("sequence") % 4 + 1).cast("int"))
    c = F.concat(tx.one_line(F.col("content")), mark)
    return _events(spark, d).select("archive_id", "event_id", tx.has_unsafe(c).alias("unsafe"), tx.has_control(c).alias("control"))


QUERIES = (
    event_projection, inspect, scan_search, token_stats, event_token_counts, inverted_index, conjunctive_search, batch_search, query_checks, bucketed_search, top_hits, evidence_window, handoff_chain,
    head_budget, head_budget_bytes, raw_tail, raw_tail_excerpts, recent_fallback, evidence_union, prompt_packing, timeline_edges, manual_edges, graph_build,
    graph_rebuild_diff, role_counts, graph_inventory, integrity_violations, annotation_orphans, index_check, posting_violations, repeated_keys, index_payload_hash,
    graph_payload_hash, recorder_caps, recorder_stream, titles, transcript_render, fence_closing, viewer_escape, viewer_selection, map_edges, annotation_groups, continuation_evidence,
    handoff_evaluation, project_search, project_verify, nfkc_tokens, html_visible_text, page_titles, markdown_events, canonical_hash, zip_roundtrip, canonical_order,
    shared_page_roundtrip, archive_roundtrip, archive_forgeries, sidecar_checks, registry_checks, bundle_files, file_texts, workspace_tables, envelope_roundtrip, continuation_packets, handoffs, conversation_briefs, viewer_pages, map_pages, prompt_plans, plan_check,
    stream_pages, snapshot_checks, snapshot_events, import_checks, import_events, project_checks, project_forgeries, mutation_batch, claims_verify, project_handoffs, project_members, package_checks,
    linked_graphs, share_urls, fetched_pages, artifact_paths, unsafe_texts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
