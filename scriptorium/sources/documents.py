"""JSON documents: normalised imports, archives, annotations, registries and projects.

A fixed schema drops keys it does not know, so the sets of keys are checked on
the raw text.  Readers give rows and violations; ``strict`` turns violations
into an error before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_control, sha256, title_of, truncate_title, utf16_length
from ..model import MAX_FILE_BYTES, MESSAGE, SHARED_ROLES
from ..operators.integrity import annotation_violations, archive_violations, breaches, event_violations, field_violations, import_violations, require_none, rederived_differences, union_all
from ..operators.projection import explode_messages, project_events, render_transcripts
from ..operators.projects import project_violations
from ..operators.shapes import shape_violations
from .files import binary_files, file_key
from .markdown import markdown_messages

#: Keys of the documents, and what their fields may be.
ARCHIVE_SCHEMAS = ("scriptorium/1",)
MAX_TRANSCRIPT_BYTES = 10 << 20
MAX_SOURCE_NAME = 160
SHARED_METHODS = ("public_shared_link", "public_shared_snapshot")
SHARED_PARSERS = ("chatgpt-share-dom/0.1", "chatgpt-share-react-router/0.2", "chatgpt-share-react-router/0.3", "dom", "stream")
IMPORT_FIELDS = ["schema", "title", "messages"]
MESSAGE_FIELDS = ["role", "content"]
IMPORT_SCHEMA = "import/1"
MANIFEST_FIELDS = ["schema", "id", "name", "version", "inputFormat", "capabilities", "securityContact"]
CAPTURE_FIELDS = {
    "manual": ["method", "confidence", "sourceName"],
    "normalized_json": ["method", "confidence", "sourceName", "sourceDocumentSha256"],
    "shared": ["method", "confidence", "provider", "capture_method", "completeness", "hidden_state_available", "source_url_sha256", "source_html_sha256", "parser"],
}
#: The keys of an archive at every depth, and their types; which keys a capture has depends on its method.
ARCHIVE_SHAPE = {
    "schema": "string", "archiveId": "string", "createdAt": "string", "title": "string",
    "capture": {"method": "string", "confidence": "string"} | {f"{f}?": "boolean" if f == "hidden_state_available" else "string" for fields in CAPTURE_FIELDS.values() for f in fields[2:]},
    "security": {"untrustedContent": "boolean", "aiProcessing": "string"},
    "transcript": {"encoding": "string", "byteLength": "integer", "sha256": "string", "content": "string"},
    "events": [{"id": "string", "sequence": "integer", "role": "string", "content": "string", "contentSha256": "string"}],
    "normalizedSource?": {"schema": "string", "title": "string", "messages": [{"role": "string", "content": "string"}]},
}
IMPORT = "struct<schema:string,title:string,messages:array<struct<role:string,content:string>>>"
ARCHIVE = (
    "struct<schema:string,archiveId:string,createdAt:string,title:string,"
    "capture:struct<method:string,confidence:string,sourceName:string,sourceDocumentSha256:string,provider:string,capture_method:string,completeness:string,hidden_state_available:boolean,source_url_sha256:string,source_html_sha256:string,parser:string>,"
    "security:struct<untrustedContent:boolean,aiProcessing:string>,transcript:struct<encoding:string,byteLength:bigint,sha256:string,content:string>,"
    "events:array<struct<id:string,sequence:int,role:string,content:string,contentSha256:string>>,normalizedSource:" + IMPORT + ">"
)


def texts_of(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(archive_id, path, raw, problem) of files (path, length, content) as whole texts; ``problem`` for those too large, empty or not UTF-8.

    Identifiers come from paths, so reruns agree.
    """
    problem = F.when(F.col("length") > max_bytes, "too large").when(F.col("length") == 0, "empty").when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    raw = F.when(problem.isNull(), F.decode("content", "UTF-8"))
    return files.select(F.xxhash64("path").alias("archive_id"), "path", raw.alias("raw"), problem.alias("problem"))


def read_texts(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """:func:`texts_of` the files at a path."""
    return texts_of(binary_files(spark, path), max_bytes)


def file_violations(texts: DataFrame) -> DataFrame:
    return texts.filter("problem is not null").select("archive_id", F.col("problem").alias("rule"), F.col("path").alias("subject"))


def _nested_fields(raw: DataFrame, path: str, allowed: list[str]) -> DataFrame:
    """Unknown keys of the objects in an array of a JSON text."""
    items = F.from_json(F.get_json_object("raw", path), "array<string>")
    return field_violations(raw.select("archive_id", F.explode(items).alias("raw")), allowed)


def parse_imports(texts: DataFrame, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(imports, violations) of texts (archive_id, raw).

    Imports have archive_id, title, messages and source_sha256, the hash of the
    text itself.  ``schema`` is the schema name to demand.
    """
    doc = texts.select("archive_id", "raw", sha256(F.col("raw")).alias("source_sha256"), F.from_json("raw", IMPORT).alias("d"))
    imports = doc.select("archive_id", "d.title", "d.messages", "source_sha256", F.col("d.schema").alias("schema"))
    bad = [import_violations(imports), field_violations(texts, IMPORT_FIELDS), _nested_fields(texts, "$.messages", MESSAGE_FIELDS)]
    bad.append(texts.filter(F.json_object_keys("raw").isNull()).select("archive_id", F.lit("not a JSON object").alias("rule"), F.lit(None).cast("string").alias("subject")))
    if schema:
        bad.append(imports.filter(~F.col("schema").eqNullSafe(F.lit(schema))).select("archive_id", F.lit("schema").alias("rule"), F.col("schema").alias("subject")))
    return imports, union_all(bad)


def import_json(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archives, events, violations) of normalised imports; archives carry their rendered transcript."""
    texts = read_texts(spark, path)
    imports, bad = parse_imports(texts.filter("problem is null"), schema)
    bad = bad.unionByName(file_violations(texts))
    if strict:
        require_none(bad, "import")
    events = project_events(explode_messages(imports))
    archives = imports.select("archive_id", "title", "source_sha256").join(render_transcripts(events, imports.select("archive_id", "title")), "archive_id")
    return archives.withColumn("transcript_sha256", sha256(F.col("transcript"))).withColumn("byte_length", F.octet_length("transcript")), events, bad


def parse_archives(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archives, events) of archive texts (archive_id, raw)."""
    a = texts.select("archive_id", "raw", F.from_json("raw", ARCHIVE).alias("d"))
    archives = a.select(
        "archive_id", F.col("d.archiveId").alias("stored_id"), F.col("d.schema").alias("schema"), "d.title", F.col("d.createdAt").alias("created_at"), "d.capture", "d.security",
        F.col("d.transcript.content").alias("transcript"), F.col("d.transcript.sha256").alias("transcript_sha256"), F.col("d.transcript.byteLength").alias("byte_length"), F.col("d.transcript.encoding").alias("encoding"), F.col("d.normalizedSource.messages").alias("messages"),
        F.col("d.normalizedSource.schema").alias("source_schema"), F.col("d.normalizedSource.title").alias("source_title"),
        F.coalesce(F.forall(F.transform("d.events", lambda e, i: e["sequence"] == i), lambda x: F.coalesce(x, F.lit(False))), F.lit(True)).alias("in_order"),
    )
    e = a.select("archive_id", F.explode("d.events").alias("e"))
    events = e.select("archive_id", F.col("e.id").alias("event_id"), "e.sequence", "e.role", "e.content", F.col("e.contentSha256").alias("content_sha256"))
    return archives, events


def _capture_rules(archives: DataFrame) -> DataFrame:
    """What of an archive's own fields and of how it was captured breaks a rule, each by its name."""
    c = {f: F.col(f"capture.{f}") for f in (*CAPTURE_FIELDS["shared"], "sourceName", "sourceDocumentSha256")}
    said = F.coalesce(c["method"], F.lit(""))
    manual, normalized, shared = said == "manual", said == "normalized_json", said.isin(*SHARED_METHODS)
    is_hash = lambda x: F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))
    sure = F.when(shared, "visible_snapshot").otherwise(said)
    rules = {
        "schema": ~F.coalesce(F.col("schema").isin(*ARCHIVE_SCHEMAS), F.lit(False)),
        "archive id": ~F.coalesce(F.col("stored_id").rlike("^arc_[0-9a-f-]{36}$"), F.lit(False)),
        "encoding": ~F.col("encoding").eqNullSafe("utf-8"),
        "transcript too long": F.octet_length("transcript") > MAX_TRANSCRIPT_BYTES,
        "security": ~F.coalesce(F.col("security.untrustedContent") & (F.col("security.aiProcessing") == "not-used"), F.lit(False)),
        "capture method": ~(manual | normalized | shared),
        "capture confidence": ~c["confidence"].eqNullSafe(sure),
        "source name": F.coalesce((utf16_length(c["sourceName"]) > MAX_SOURCE_NAME) | has_control(c["sourceName"]), F.lit(False)),
        "source hash": normalized & ~is_hash(c["sourceDocumentSha256"]),
        "shared capture": shared & ~(
            c["provider"].eqNullSafe("chatgpt") & c["capture_method"].eqNullSafe(said) & c["completeness"].eqNullSafe("visible_snapshot") & c["hidden_state_available"].eqNullSafe(False)
            & is_hash(c["source_url_sha256"]) & is_hash(c["source_html_sha256"]) & F.coalesce(c["parser"].isin(*SHARED_PARSERS), F.lit(False))
        ),
        "normalized source": F.when(manual, F.col("messages").isNotNull()).otherwise(F.col("messages").isNull() & (normalized | shared)),
        "source schema": F.col("messages").isNotNull() & ~F.col("source_schema").eqNullSafe(IMPORT_SCHEMA),
        "role not shown": shared & F.coalesce(F.exists("messages", lambda m: ~F.coalesce(m["role"].isin(*SHARED_ROLES), F.lit(False))), F.lit(False)),
        "events out of order": ~F.col("in_order"),
        "title differs": manual & ~F.col("title").eqNullSafe(title_of(F.col("transcript"))),
    }
    return breaches(archives, rules, c["method"])


def _source_rules(archives: DataFrame) -> DataFrame:
    """Archives with a source that is no sound import, or whose title or transcript is not what the source renders to."""
    source = archives.filter("messages is not null")
    imports = source.select("archive_id", F.col("source_title").alias("title"), "messages")
    rendered = render_transcripts(explode_messages(imports), imports.select("archive_id", "title")).withColumnRenamed("transcript", "_rendered")
    # an import without messages breaks a rule of its own and renders to nothing
    both = source.select("archive_id", "title", "source_title", "transcript").join(rendered, "archive_id")
    differ = {"title differs from the source": ~F.col("title").eqNullSafe(F.col("source_title")), "transcript differs from the source": ~F.col("transcript").eqNullSafe(F.col("_rendered"))}
    broken = import_violations(imports)
    return breaches(both, differ, F.col("archive_id")).unionByName(broken.select("archive_id", F.concat(F.lit("source: "), "rule").alias("rule"), "subject"))


def archive_text_violations(texts: DataFrame) -> DataFrame:
    """Everything that is wrong with archive texts.

    Keys and types at every depth, the archive's own fields and hashes, the
    source it was made from, and a title, transcript or events other than that
    source gives.
    """
    archives, events = parse_archives(texts)
    captured = texts.select("archive_id", F.get_json_object("raw", "$.capture").alias("raw"), F.get_json_object("raw", "$.capture.method").alias("m"))
    parts = [
        shape_violations(texts, ARCHIVE_SHAPE),
        field_violations(captured.filter("m = 'manual'"), CAPTURE_FIELDS["manual"]),
        field_violations(captured.filter("m = 'normalized_json'"), CAPTURE_FIELDS["normalized_json"]),
        field_violations(captured.filter("m not in ('manual', 'normalized_json')"), CAPTURE_FIELDS["shared"]),
        archive_violations(archives),
        event_violations(events),
        _capture_rules(archives),
        _source_rules(archives),
    ]
    columns = ["archive_id", "event_id", "sequence", "role", "content", "content_sha256"]
    spoken = archives.filter("capture.method = 'manual'").select("archive_id", "transcript")
    sources = archives.filter("capture.method <> 'manual' and messages is not null").select("archive_id", "messages")
    derived = project_events(markdown_messages(spoken)).select(columns).unionByName(project_events(explode_messages(sources)).select(columns))
    based = events.join(spoken.select("archive_id").unionByName(sources.select("archive_id")), "archive_id", "left_semi").select(columns)
    differ = rederived_differences(based, derived)
    parts.append(differ.select("archive_id", F.lit("events differ from the source").alias("rule"), F.col("event_id").alias("subject")))
    return union_all(parts)


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(archives, events) of archive files, checked as a whole."""
    texts = read_texts(spark, path)
    if strict:
        require_none(file_violations(texts), "archive file")
        require_none(archive_text_violations(texts), "archive")
    return parse_archives(texts)


#: The keys of a sidecar of annotations, their types, and how a sidecar's name follows from its archive's.
ANNOTATIONS_SHAPE = {"schema": "string", "archiveId": "string", "items": [{"eventId": "string", "kind": "string", "note": "string", "createdAt": "string"}]}
SIDECAR = r"\.annotations\.json$"


def load_sidecars(spark: SparkSession, path: str, key: Column | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(key, path, raw, problem) of sidecar files by what the file's own path says.

    The key is the archive's path, or ``key`` made of the path of the sidecar
    in the column ``_path``.  ``problem`` is ``empty``, or ``unreadable`` for
    what is too large or not UTF-8.
    """
    f = binary_files(spark, path).select(F.col("path").alias("_path"), F.col("length").alias("size"), F.col("content").cast("string").alias("text"))
    of = file_key(F.regexp_replace("_path", SIDECAR, "")) if key is None else key
    problem = F.when((F.col("size") > max_bytes) | ~F.is_valid_utf8("text"), "unreadable").when(F.trim("text", F.lit(" \t\r\n")) == "", "empty")
    return f.select(of.alias("key"), F.col("_path").alias("path"), F.when(problem.isNull(), F.col("text")).alias("raw"), problem.alias("problem"))


def sidecar_states(archives: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(archive_id, stored_id, path, raw, state) of archives (key, archive_id, stored_id) and sidecars, joined from both sides.

    Keys are :func:`file_key` of the archives' paths, or what the sidecars were loaded with.

    ``missing`` is no fault: such an archive has no annotations.  ``empty`` and
    ``unreadable`` are, for what stood there is not known; so is a ``stray``
    sidecar, which has no archive and a null archive_id.  All others are
    ``read``.
    """
    j = archives.select("key", "archive_id", "stored_id").join(sidecars, "key", "full_outer")
    readable = F.try_parse_json("raw").isNotNull()
    state = F.when(F.col("archive_id").isNull(), "stray").when(F.col("path").isNull(), "missing").when(F.col("problem").isNotNull(), F.col("problem")).when(~readable, "unreadable").otherwise("read")
    return j.select("archive_id", "stored_id", "path", "raw", state.alias("state"))


def read_annotations(states: DataFrame, events: DataFrame, schema: str = "annotations/1") -> tuple[DataFrame, DataFrame]:
    """(annotations, violations) of archives' sidecars as :func:`sidecar_states` found them.

    Annotations have archive_id, pos, event_id, kind, note and created_at.
    Violations name what is empty, unreadable or stray, keys and types at every
    depth, a sidecar of another archive, and annotations that break a rule.
    """
    bad = states.filter(F.col("state").isin("empty", "unreadable", "stray")).select("archive_id", F.concat(F.lit("sidecar "), "state").alias("rule"), F.col("path").alias("subject"))
    texts = states.filter("state = 'read'")
    whole = F.from_json("raw", "struct<schema:string,archiveId:string,items:array<struct<eventId:string,kind:string,note:string,createdAt:string>>>")
    read = texts.select("archive_id", "stored_id", "path", whole.alias("d"))
    rows = read.select("archive_id", F.posexplode("d.items").alias("pos", "i")).select("archive_id", "pos", F.col("i.eventId").alias("event_id"), "i.kind", "i.note", F.col("i.createdAt").alias("created_at"))
    own = breaches(read, {"sidecar schema": ~F.col("d.schema").eqNullSafe(schema), "sidecar of another archive": ~F.col("d.archiveId").eqNullSafe(F.col("stored_id"))}, F.col("path"))
    return rows, union_all([bad, shape_violations(texts.select("archive_id", "raw"), ANNOTATIONS_SHAPE), own, annotation_violations(rows, events)])


def parse_registry(spark: SparkSession, text: str, input_format: str) -> tuple[DataFrame, DataFrame]:
    """:func:`parse_registries` of one text, whose archive_id is 0."""
    return parse_registries(spark.createDataFrame([(0, text)], "archive_id long, raw string"), input_format)


def parse_registries(raw: DataFrame, input_format: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, violations) of adapter registries (archive_id, raw); manifests are data and nothing in them is run."""
    m = raw.select("archive_id", F.explode(F.from_json(F.get_json_object("raw", "$.adapters"), "array<string>")).alias("raw"))
    fields = "struct<schema:string,id:string,name:string,version:string,inputFormat:string,capabilities:array<string>,securityContact:string>"
    manifests = m.select("archive_id", "raw", F.from_json("raw", fields).alias("m")).select("archive_id", "m.*")
    text_ok = lambda c, most: utf16_length(F.col(c)).between(1, most) & ~has_control(F.col(c))
    rule = (
        F.when(~F.coalesce(F.col("id").rlike("^[a-z][a-z0-9-]{1,62}$"), F.lit(False)), "id")
        .when(~F.coalesce(text_ok("name", 80), F.lit(False)), "name")
        .when(~F.coalesce(F.col("version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+(-[A-Za-z0-9.-]+)?$"), F.lit(False)), "version")
        .when(~F.col("inputFormat").eqNullSafe(input_format), "inputFormat")
        .when(~F.coalesce((F.size("capabilities") > 0) & F.forall("capabilities", lambda x: x == "normalize-only"), F.lit(False)), "capabilities")
        .when(~F.coalesce(text_ok("securityContact", 200), F.lit(False)), "securityContact")
    )
    bad = [manifests.select("archive_id", rule.alias("rule"), F.col("id").alias("subject")).filter("rule is not null"), field_violations(raw, ["schema", "adapters"]), field_violations(m, MANIFEST_FIELDS)]
    bad.append(manifests.filter("id is not null").groupBy("archive_id", "id").count().filter("count > 1").select("archive_id", F.lit("id repeated").alias("rule"), F.col("id").alias("subject")))
    return manifests, union_all(bad)


def stored_id(archive_id: Column) -> Column:
    """The identifier that a document carries: made of the archive's own, so that reruns agree."""
    digest = sha256(archive_id.cast("string"))
    return F.concat_ws("-", F.concat(F.lit("arc_"), F.substring(digest, 1, 8)), *[F.substring(digest, at, n) for at, n in ((9, 4), (13, 4), (17, 4), (21, 12))])


def archive_documents(archives: DataFrame, events: DataFrame, schema: str = "scriptorium/1") -> DataFrame:
    """(archive_id, raw): archives as JSON texts; ``archives`` has title, transcript, created_at, source_name and perhaps messages."""
    e = F.sort_array(F.collect_list(F.struct("sequence", "event_id", "role", "content", "content_sha256")))
    listed = events.groupBy("archive_id").agg(F.transform(e, lambda x: F.struct(x["event_id"].alias("id"), x["sequence"].alias("sequence"), x["role"].alias("role"), x["content"].alias("content"), x["content_sha256"].alias("contentSha256"))).alias("events"))
    t = F.col("transcript")
    j = archives.join(listed, "archive_id")
    messages = F.col("messages") if "messages" in archives.columns else F.lit(None).cast(f"array<{MESSAGE.simpleString()}>")
    source_hash = F.col("source_sha256") if "source_sha256" in archives.columns else F.lit(None).cast("string")
    normal = F.when(messages.isNotNull(), F.struct(F.lit("import/1").alias("schema"), F.col("title").alias("title"), messages.alias("messages")))
    capture = F.struct(F.when(messages.isNull(), "manual").otherwise("normalized_json").alias("method"), F.when(messages.isNull(), "manual").otherwise("normalized_json").alias("confidence"), F.left("source_name", F.lit(MAX_SOURCE_NAME)).alias("sourceName"), source_hash.alias("sourceDocumentSha256"))
    doc = F.struct(
        F.lit(schema).alias("schema"), stored_id(F.col("archive_id")).alias("archiveId"), F.col("created_at").alias("createdAt"), truncate_title(F.col("title")).alias("title"), capture.alias("capture"),
        F.struct(F.lit(True).alias("untrustedContent"), F.lit("not-used").alias("aiProcessing")).alias("security"),
        F.struct(F.lit("utf-8").alias("encoding"), F.octet_length(t).cast("long").alias("byteLength"), sha256(t).alias("sha256"), t.alias("content")).alias("transcript"), "events", normal.alias("normalizedSource"),
    )
    return j.select("archive_id", F.to_json(doc).alias("raw"))


PROJECT_SCHEMA = "project/1"
#: The keys of a project at every depth, and their types.
PROJECT_SHAPE = {
    "schema": "string", "projectId": "string", "name": "string", "createdAt": "string",
    "archives": [{"id": "string", "path": "string", "title": "string", "transcriptSha256": "string", "archiveSha256": "string"}],
    "artifacts": [{"id": "string", "kind": "string", "path": "string", "name": "string", "sha256?": "string", "head?": "string"}],
    "edges": [{"from": "string", "to": "string", "kind": "string"}],
    "claims": [{"id": "string", "archiveId": "string", "eventId": "string", "kind": "string", "note": "string", "createdAt": "string"}],
}


def parse_projects(texts: DataFrame) -> dict[str, DataFrame]:
    """Relations of project texts (archive_id, raw): projects, members, artifacts, edges, claims, and violations of their fields."""

    def rows(name: str, fields: dict[str, str]) -> DataFrame:
        kind = "array<struct<" + ",".join(f"`{f.removesuffix('?')}`:string" for f in PROJECT_SHAPE[name][0]) + ">>"
        r = texts.select(F.get_json_object("raw", "$.projectId").alias("project_id"), F.explode(F.from_json(F.get_json_object("raw", f"$.{name}"), kind)).alias("r"))
        return r.select("project_id", *[F.col(f"r.{f}").alias(c) for f, c in fields.items()])

    fields = lambda shape: [f.removesuffix("?") for f in shape]
    bad = [field_violations(texts, fields(PROJECT_SHAPE))] + [_nested_fields(texts, f"$.{n}", fields(s[0])) for n, s in PROJECT_SHAPE.items() if isinstance(s, list)]
    return {
        "projects": texts.select(F.get_json_object("raw", "$.projectId").alias("project_id"), F.get_json_object("raw", "$.schema").alias("schema"), F.get_json_object("raw", "$.name").alias("name"), F.get_json_object("raw", "$.createdAt").alias("created_at")),
        "members": rows("archives", {"id": "archive_id", "path": "path", "title": "title", "transcriptSha256": "transcript_sha256", "archiveSha256": "archive_sha256"}),
        "artifacts": rows("artifacts", {"id": "artifact_id", "kind": "kind", "path": "path", "name": "name", "sha256": "sha256", "head": "head"}),
        "edges": rows("edges", {"from": "from_id", "to": "to_id", "kind": "kind"}),
        "claims": rows("claims", {"id": "claim_id", "archiveId": "archive_id", "eventId": "event_id", "kind": "kind", "note": "note", "createdAt": "created_at"}),
        "violations": union_all(bad),
    }


def project_text_violations(texts: DataFrame, schema: str = PROJECT_SCHEMA) -> DataFrame:
    """(project_id, rule, subject): everything that is wrong with project texts (archive_id, raw), at every depth and between their parts."""
    p = parse_projects(texts)
    named = texts.select("archive_id", F.get_json_object("raw", "$.projectId").alias("project_id"))
    shaped = shape_violations(texts, PROJECT_SHAPE).join(named, "archive_id").select("project_id", "rule", "subject")
    other = p["projects"].filter(~F.col("schema").eqNullSafe(schema)).select("project_id", F.lit("schema").alias("rule"), F.col("schema").alias("subject"))
    return union_all([shaped, other, project_violations(p["members"], p["artifacts"], p["edges"], p["claims"], projects=p["projects"])])


def read_projects(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """:func:`parse_projects` of files; whatever is wrong with one is an error."""
    texts = read_texts(spark, path)
    require_none(file_violations(texts), "project file")
    bad = project_text_violations(texts)
    require_none(bad.withColumnRenamed("project_id", "archive_id"), "project")
    return parse_projects(texts)
