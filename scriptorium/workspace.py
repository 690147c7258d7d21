"""A workspace: the engine's relations as tables below one path, and a method for each command.

Commands commit what they change as a whole, over all tables, and several
writers may be at work (:mod:`.sinks.log`): additions hold new rows alone,
changes hold the whole, and a reader takes the last whole one and the additions
after it.  Every method works on all archives of the workspace, or on those named by ``archive_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import EVENTS, InputError
from .operators import briefs, evidence, graph, index, integrity, mutations, planning, projects, search
from .operators.projection import inspect_events
from .sinks import tables
from .sinks.log import Commits, R, Transaction, transact
from .sources import documents, envelopes, files, packages, remote, snapshots
from .sources.markdown import import_markdown

SCHEMAS = {
    "archives": "archive_id long, title string, transcript string, transcript_sha256 string, byte_length long, created_at string, source_name string, confidence string",
    "events": ", ".join(f"{f.name} {'long' if f.name == 'archive_id' else f.dataType.simpleString()}" for f in EVENTS),
    "postings": "archive_id long, term string, event_ids array<string>",
    "annotations": "archive_id long, pos int, event_id string, kind string, note string, created_at string",
    "graph": "archive_id long, part int, rank int, from_id string, to_id string, kind string",
    "projects": "project_id string, name string, created_at string",
    "members": "project_id string, archive_id long, transcript_sha256 string",
    "artifacts": "project_id string, artifact_id string, path string, name string, sha256 string, head string",
    "edges": "project_id string, from_id string, to_id string, kind string",
    "claims": "project_id string, claim_id string, archive_id long, event_id string, kind string, note string",
    "verdicts": "seq long, op string, rule string",
}


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, self.root)

    # tables

    def _transact(self, work: Callable[[Transaction], R]) -> R:
        return transact(self.commits, SCHEMAS, work)

    def table(self, name: str) -> DataFrame:
        return Transaction(self.commits, SCHEMAS).table(name)

    def _write(self, name: str, df: DataFrame, kind: str = "all") -> None:
        self._transact(lambda t: t.put(name, df, kind))

    def clear(self) -> list[str]:
        """Deletes data that belong to no commit; not while others write."""
        gone = self.commits.unused()
        for folder in gone:
            self.commits.delete(folder)
        return gone

    def _of(self, name: str, archive_id: int | None) -> DataFrame:
        t = self.table(name)
        return t if archive_id is None else t.filter(F.col("archive_id") == archive_id)

    # archives

    def _store(self, archives: DataFrame, events: DataFrame, created_at: str) -> DataFrame:
        terms = index.event_terms(events)
        over = index.term_totals(terms).filter("not within_limits").select("archive_id", F.lit("index limits").alias("rule"), F.col("terms").cast("string").alias("subject"))
        integrity.require_none(over, "import")  # before anything is written
        for column, value in (("created_at", created_at), ("confidence", "user_supplied"), ("source_name", "")):
            if column not in archives.columns:
                archives = archives.withColumn(column, F.lit(value))
        if "byte_length" not in archives.columns:
            archives = archives.withColumn("byte_length", F.octet_length("transcript"))
        built = index.postings(terms)

        def store(t: Transaction) -> None:
            t.add("archives", archives, ["archive_id"])
            t.add("events", events, ["archive_id", "event_id"])
            t.add("postings", built, ["archive_id", "term"])

        self._transact(store)
        return archives.select("archive_id", "title", "transcript_sha256")

    def import_markdown(self, path: str, created_at: str) -> DataFrame:
        return self._store(*import_markdown(self.spark, path), created_at)

    def import_json(self, path: str, created_at: str, schema: str | None = None) -> DataFrame:
        archives, events, _ = documents.import_json(self.spark, path, schema)
        return self._store(archives, events, created_at)

    def import_snapshots(self, html_path: str, meta_path: str, created_at: str) -> DataFrame:
        archives, events, bad = snapshots.import_snapshots(snapshots.load_snapshots(self.spark, html_path, meta_path))
        integrity.require_none(bad, "snapshot")
        return self._store(archives, events, created_at)

    def fetch_shared(self, urls: DataFrame, get: remote.Get, path: str, captured_at: str) -> DataFrame:
        """Pages of (archive_id, url) by ``get``, those that could be had written to ``path`` as snapshots; (archive_id, url, error)."""
        pages = remote.fetch_pages(urls, get)
        remote.snapshots_of(pages, captured_at).write.mode("errorifexists").parquet(path)
        return pages.select("archive_id", "url", "error")

    def import_shared(self, urls: DataFrame, get: remote.Get, created_at: str) -> DataFrame:
        """Conversations at (archive_id, url) by ``get``; one that cannot be had or read makes the whole an error."""
        archives, events, bad = remote.import_shared(remote.fetch_pages(urls, get), created_at)
        integrity.require_none(bad, "shared page")
        return self._store(archives, events, created_at)

    def inspect(self, archive_id: int | None = None) -> DataFrame:
        return inspect_events(self._of("events", archive_id))

    def build_index(self) -> None:
        self._transact(lambda t: t.put("postings", index.postings(index.event_terms(t.table("events")))))

    def verify_index(self, archive_id: int | None = None) -> DataFrame:
        return index.index_differences(self._of("postings", archive_id), self._of("events", archive_id))

    def verify(self, archive_id: int | None = None) -> DataFrame:
        archives = self._of("archives", archive_id)
        return integrity.archive_violations(archives).unionByName(integrity.event_violations(self._of("events", archive_id)))

    def search(self, query: str, archive_id: int | None = None, scan: bool = False) -> DataFrame:
        """By terms, or with ``scan`` by substring; the two are different questions."""
        events = self._of("events", archive_id)
        return search.search_scan(events, query) if scan else search.search_terms(events, self._of("postings", archive_id), query)

    def annotate(self, new: DataFrame) -> None:
        """Adds (archive_id, event_id, kind, note, created_at)."""
        self._transact(lambda t: t.put("annotations", tables.add_annotations(t.table("annotations"), new, t.table("events"))))

    def _chosen(self, query: str | None, archive_id: int | None) -> DataFrame | None:
        if query is None:
            return None
        hits = search.top_hits(self.search(query, archive_id))
        window = evidence.expand_window(hits, self._of("events", archive_id))
        return window.select("archive_id", "event_id", F.col("sequence").alias("pos"))

    def continue_(self, query: str | None = None, selected: DataFrame | None = None, archive_id: int | None = None) -> DataFrame:
        if query is not None and selected is not None:
            raise InputError("give a query or a selection, not both")
        chosen = selected if selected is not None else self._chosen(query, archive_id)
        return planning.continuation_packets(self._of("archives", archive_id), self._of("events", archive_id), self._of("annotations", archive_id), chosen)

    def handoff(self, query: str | None = None, selected: DataFrame | None = None, archive_id: int | None = None) -> DataFrame:
        return planning.handoffs(self.continue_(query, selected, archive_id))

    def evaluate_handoff(self, query: str, task: str, archive_id: int | None = None) -> DataFrame:
        events = self._of("events", archive_id)
        wanted = self._chosen(query, archive_id)
        rest = evidence.last_events(events, 8).join(wanted.select("archive_id").distinct(), "archive_id", "left_anti")
        ids = wanted.select("archive_id", "event_id").unionByName(rest.select("archive_id", "event_id"))
        chosen = events.join(ids, ["archive_id", "event_id"], "left_semi")
        none = self.table("annotations").limit(0)  # notes would give one side more than the other
        packets = planning.continuation_packets(self._of("archives", archive_id), events, none, chosen.select("archive_id", "event_id", F.col("sequence").alias("pos")))
        return planning.evaluations(self._of("archives", archive_id), chosen, events, planning.handoffs(packets), query, task, "terms")

    # graphs

    def build_graph(self) -> None:
        self._transact(lambda t: t.put("graph", graph.rebuild_graph(t.table("graph"), t.table("events"))))

    def verify_graph(self, archive_id: int | None = None) -> DataFrame:
        return graph.graph_differences(self._of("graph", archive_id), self._of("events", archive_id))

    def link(self, edges: DataFrame) -> None:
        """Adds (archive_id, from_id, to_id, kind); raises if any edge, old or new, is unsound."""

        def add(t: Transaction) -> None:
            events = t.table("events")
            old = graph.only_manual(t.table("graph")).select("archive_id", "from_id", "to_id", "kind")
            bad = graph.manual_edges(old.unionByName(edges.select(old.columns)), events).filter("problem is not null")
            integrity.require_none(bad.select("archive_id", F.col("problem").alias("rule"), F.col("from_id").alias("subject")), "edge")
            t.put("graph", graph.link_events(t.table("graph"), events, edges))

        self._transact(add)

    def _graph(self, archive_id: int | None) -> DataFrame:
        return graph.rebuild_graph(self._of("graph", archive_id), self._of("events", archive_id))

    def brief(self, archive_id: int | None = None) -> DataFrame:
        return briefs.brief(self._of("archives", archive_id), self._of("events", archive_id), self._of("annotations", archive_id), self._graph(archive_id))

    def graph_viewer(self, query: str | None = None, archive_id: int | None = None) -> DataFrame:
        """Without hits the last events are shown."""
        return briefs.map_viewer(self._of("archives", archive_id), self._of("events", archive_id), self._graph(archive_id), self._chosen(query, archive_id))

    def viewer(self, archive_id: int | None = None) -> DataFrame:
        return briefs.viewer(self._of("archives", archive_id), self._of("events", archive_id), self._of("annotations", archive_id))

    # packages and envelopes

    def documents(self, archive_id: int | None = None) -> DataFrame:
        return documents.archive_documents(self._of("archives", archive_id), self._of("events", archive_id))

    def export_packages(self, archive_id: int | None = None) -> DataFrame:
        """(archive_id, content): one package for each archive; the index is made anew."""
        events = self._of("events", archive_id)
        built = index.postings(index.event_terms(events))
        terms = built.groupBy("archive_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("term", "event_ids")))).alias("raw"))
        notes = self._of("annotations", archive_id).groupBy("archive_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("pos", "event_id", "kind", "note", "created_at")))).alias("raw"))
        links = graph.only_manual(self._of("graph", archive_id)).select("archive_id").distinct().join(self._graph(archive_id), "archive_id").groupBy("archive_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("part", "rank", "from_id", "to_id", "kind")))).alias("raw"))
        parts = [(self.documents(archive_id), packages.ENTRIES[1]), (terms, packages.ENTRIES[2]), (notes, packages.ENTRIES[3]), (links, packages.ENTRIES[4])]
        data = integrity.union_all([df.select("archive_id", F.lit(name).alias("name"), F.encode("raw", "UTF-8").alias("data")) for df, name in parts])
        listed = packages.manifests(data).select("archive_id", F.lit(packages.ENTRIES[0]).alias("name"), F.encode("manifest", "UTF-8").alias("data"))
        return packages.pack_archives(data.unionByName(listed), packages.ENTRIES)

    def import_packages(self, path: str, created_at: str) -> DataFrame:
        entries = packages.read_packages(packages.load_packages(self.spark, path), packages.ENTRIES)
        text = entries.select("archive_id", "name", "data", F.decode("data", "UTF-8").alias("raw"))
        listed = F.from_json(F.get_json_object("raw", "$.files"), "array<struct<path:string,byteLength:int,sha256:string>>")
        manifest = text.filter(F.col("name") == packages.ENTRIES[0]).select("archive_id", F.explode(listed).alias("f")).select("archive_id", "f.*")
        integrity.require_none(packages.manifest_violations(entries, manifest), "package")
        archive = text.filter(F.col("name") == packages.ENTRIES[1]).select("archive_id", "raw")
        integrity.require_none(documents.archive_text_violations(archive), "archive")
        archives, events = documents.parse_archives(archive)
        stored = text.filter(F.col("name") == packages.ENTRIES[2]).select("archive_id", F.explode(F.from_json("raw", "array<struct<term:string,event_ids:array<string>>>")).alias("t")).select("archive_id", "t.*")
        different = index.index_differences(stored, events)
        integrity.require_none(different.select("archive_id", F.col("side").alias("rule"), F.col("term").alias("subject")), "index")
        return self._store(archives.withColumn("confidence", F.col("capture.confidence")).withColumn("source_name", F.col("capture.sourceName")), events, created_at)

    def encrypt(self, passphrase: bytes, archive_id: int | None = None) -> DataFrame:
        return envelopes.encrypt(self.documents(archive_id).select("archive_id", F.encode("raw", "UTF-8").alias("content")), passphrase)

    def decrypt(self, sealed: DataFrame, passphrase: bytes) -> DataFrame:
        return envelopes.decrypt(sealed, passphrase)

    def plan(self, provider: str, model: str, task: str, query: str | None = None, archive_id: int | None = None, **limits) -> DataFrame:
        return planning.prompt_plans(self._of("archives", archive_id), self._of("events", archive_id), provider, model, task, query, **limits)

    # projects

    def new_project(self, project_id: str, name: str, created_at: str) -> None:
        self._transact(lambda t: t.add("projects", projects.new_project(self.spark, project_id, name, created_at), ["project_id"]))

    def add_archives(self, project_id: str, archive_ids: list[int]) -> None:
        def add(t: Transaction) -> None:
            new = t.table("archives").filter(F.col("archive_id").isin(archive_ids)).select(F.lit(project_id).alias("project_id"), "archive_id", "transcript_sha256")
            t.put("members", projects.add_members(t.table("members"), new))

        self._transact(add)

    def _artifact(self, project_id: str, found: DataFrame) -> None:
        new = found.select(F.lit(project_id).alias("project_id"), F.concat(F.lit("art_"), F.left(F.sha2("path", 256), F.lit(32))).alias("artifact_id"), "path", "name", "sha256", "head")
        self._transact(lambda t: t.add("artifacts", new, ["project_id", "artifact_id"]))

    def add_file(self, project_id: str, path: str, root: str) -> None:
        self._artifact(project_id, files.file_artifacts(self.spark, path, root))

    def add_repository(self, project_id: str, directory: str, root: str) -> None:
        self._artifact(project_id, files.repository_artifact(self.spark, directory, root))

    def _checked(self, t: Transaction, **changed: DataFrame) -> None:
        now = {n: changed.get(n, t.table(n)) for n in ("members", "artifacts", "edges", "claims")}
        bad = projects.project_violations(now["members"], now["artifacts"], now["edges"], now["claims"], id_formats=False)
        integrity.require_none(bad.withColumnRenamed("project_id", "archive_id"), "project")
        for name, df in changed.items():
            t.put(name, df)

    def link_nodes(self, edges: DataFrame) -> None:
        """Adds (project_id, from_id, to_id, kind); ``related`` has no direction."""
        new = projects.canonical_edges(edges).select("project_id", "from_id", "to_id", "kind")
        self._transact(lambda t: self._checked(t, edges=t.table("edges").unionByName(new)))

    def claim(self, claims: DataFrame) -> None:
        """Adds (project_id, claim_id, archive_id, event_id, kind, note) on unchanged members."""

        def add(t: Transaction) -> None:
            ok = projects.verify_claims(claims, projects.verify_members(t.table("members"), t.table("archives")), t.table("events"))
            integrity.require_none(ok.filter("not valid").select(F.col("reason").alias("rule"), F.col("claim_id").alias("subject")), "claim")
            old = t.table("claims")
            self._checked(t, claims=old.unionByName(claims.select(old.columns)))

        self._transact(add)

    def apply(self, batch: DataFrame, caps: mutations.Caps = mutations.Caps()) -> DataFrame:
        """Applies an ordered batch of :data:`.operators.mutations.BATCH` in one commit; the verdicts (seq, op, rule) as they were written down.

        What is refused changes nothing, and what is applied is there as a whole.
        """
        known = {r["op"] for r in batch.select("op").filter(F.col("op").isin(*mutations.TABLES)).distinct().collect()}  # six names at most

        def work(t: Transaction) -> None:
            state = {name: t.table(name) for name in ("archives", "events", "projects", "members", "artifacts", "edges", "claims", "annotations")}
            added, verdicts = mutations.apply_batch(state, batch, caps)
            for op in sorted(known):
                name = mutations.TABLES[op][0]
                t.put(name, added[name], "add")
            t.put("verdicts", verdicts)

        self._transact(work)
        return self.table("verdicts")

    def verify_projects(self) -> tuple[DataFrame, DataFrame]:
        """(rows, verdicts) of members and claims."""
        members = projects.verify_members(self.table("members"), self.table("archives"))
        claims = projects.verify_claims(self.table("claims"), members, self.table("events"))
        rows = members.select("project_id", F.col("archive_id").cast("string").alias("id"), "valid", "reason").unionByName(claims.select("project_id", F.col("claim_id").alias("id"), "valid", "reason"))
        return rows, projects.project_verdicts(members, claims)

    def search_projects(self, query: str, scan: bool = False) -> DataFrame:
        """A member that has changed makes the whole search an error."""
        members = self.table("members")
        bad = projects.verify_members(members, self.table("archives")).filter("not valid")
        integrity.require_none(bad.select(F.col("reason").alias("rule"), F.col("archive_id").cast("string").alias("subject")), "project")
        return projects.search_projects(members, self.table("archives").select("archive_id", "title"), self.search(query, scan=scan))

    def continue_projects(self, query: str) -> DataFrame:
        rows, _ = self.verify_projects()
        integrity.require_none(rows.filter("not valid").select(F.col("reason").alias("rule"), F.col("id").alias("subject")), "project")
        return projects.project_handoff(self.table("projects"), self.table("claims"), self.table("edges"), self.search_projects(query))


#: The commands of the engine and the methods that answer them.
COMMANDS = {
    "import-markdown": "import_markdown", "import-json": "import_json", "index": "build_index", "verify-index": "verify_index", "inspect": "inspect", "search": "search", "annotate": "annotate",
    "continue": "continue_", "handoff": "handoff", "evaluate-handoff": "evaluate_handoff", "package-export": "export_packages", "package-import": "import_packages", "graph-build": "build_graph",
    "graph-verify": "verify_graph", "graph-link": "link", "graph-brief": "brief", "graph-viewer": "graph_viewer", "encrypt": "encrypt", "decrypt": "decrypt", "import-snapshot": "import_snapshots", "fetch-share": "fetch_shared", "import-share": "import_shared",
    "viewer": "viewer", "ai-plan": "plan", "project-init": "new_project", "project-add-archive": "add_archives", "project-add-file": "add_file", "project-add-repository": "add_repository",
    "project-link": "link_nodes", "project-claim": "claim", "project-verify": "verify_projects", "project-search": "search_projects", "project-continue": "continue_projects",
}
