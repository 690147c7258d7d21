import hashlib
import json
import zlib

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.flat_graph import revive
from scriptorium.functions.html_text import shared_conversation, text_of, title_of_page
from scriptorium.model import InputError
from scriptorium.operators.integrity import recorder_caps
from scriptorium.operators.projection import explode_messages, project_events, render_transcripts
from scriptorium.operators.shapes import shape_violations
from scriptorium.sinks import tables
from scriptorium.plans.catalog import queries
from scriptorium.sources import documents, envelopes, files, packages, snapshots
from scriptorium.sources.markdown import import_markdown
from scriptorium.streaming.recorder import record_stream


def test_visible_text():
    assert text_of("<p>a  b</p><p>c<br>d</p>") == "a b\n\nc\nd"
    assert text_of("<pre> x\n  y</pre>z") == "```\n x\n  y\n```\nz"
    assert text_of("<table><tr><td>1</td><td>2</td></tr></table>") == "1\t2"
    assert text_of("a<script>b</script><style>c</style>&lt;&#x1F510;&nbsp;e &amp;amp;") == "a<🔐 e &amp;"
    for bad in ("<pre>x", "<script>x", "a&#1;b"):
        with pytest.raises(InputError):
            text_of(bad)


def dom(*messages):
    return "<html><title>Plan - Site</title>" + "".join(f'<article data-message-author-role="{r}"><div>{c}</div></article>' for r, c in messages) + "</html>"


def test_dom_pages():
    title, parser, got = shared_conversation(dom(("user", "<p>hi</p>"), ("assistant", ""), ("user", "🔐")), "Site")
    assert (title, parser, got) == ("Plan", "dom", [("user", "hi"), ("assistant", ""), ("user", "🔐")])
    for bad in (dom(("tool", "x")), dom(("user", "<img src=x>")), '<div data-message-author-role="user">x', "<p>none</p>", "", "a\x01"):
        with pytest.raises(InputError):
            shared_conversation(bad)
    assert len(shared_conversation(dom(*[("user", str(i)) for i in range(240)]))[2]) == 240


def flatten(value):
    """A value as a flat graph."""
    flat = []

    def put(v):
        at = len(flat)
        flat.append(None)
        if isinstance(v, dict):
            flat[at] = {f"_{put(k)}": put(x) for k, x in v.items()}
        elif isinstance(v, list):
            flat[at] = [put(x) for x in v]
        else:
            flat[at] = v
        return at

    put(value)
    return flat


def stream(*nodes):
    flat = flatten({"data": {"linear_conversation": list(nodes)}})
    return "<title>T</title><script>window.__reactRouterContext.streamController.enqueue(" + json.dumps(json.dumps(flat)) + ");</script>"


def node(i, role, *parts, **more):
    return {"message": {"id": f"m{i}", "author": {"role": role}, "content": {"content_type": "text", "parts": list(parts)}, **more}}


def test_stream_pages():
    page = stream({"message": None}, node(1, "system", "s"), node(2, "user", "a", "b"), node(3, "odd", "x", is_redacted=True), node(4, "assistant", "c"), node(5, "user", "Original custom instructions no longer available"))
    assert shared_conversation(page)[1:] == ("stream", [("user", "a\nb"), ("assistant", "c")])
    for bad in (stream(node(1, "odd", "x")), stream(node(1, "user", "x", message_source="y")), stream(node(1, "user", "a"), node(1, "user", "b")), stream(node(1, "user", 7)), page[:150]):
        with pytest.raises(InputError):
            shared_conversation(bad)


def test_flat_graphs():
    assert revive([[1, 2, 1.0, -1, 0.5, True], {"_3": 4}, "t", "k", [0]])[0]["k"][0][1] == "t"
    value = {"a": [1.5, None, True, {"b": "c", "d": []}], "e": "a"}
    assert revive(flatten(value)) == value
    deep = [[i + 1] for i in range(201)]
    assert revive([*deep[:199], "end"]) and revive(["alone", {"bad": 7}]) == "alone"
    for bad in ([*deep, "end"], [{"_1": 2, "_3": 2}, "k", 1, "k"], [{"_9": 0}], [[1.0], [7]], [[1], {"_0": 1}]):
        with pytest.raises(InputError):
            revive(bad)


def test_titles_lose_the_providers_name():
    title = lambda t: title_of_page(f"<title>{t}</title>", "ChatGPT")
    assert [title(t) for t in ("A - ChatGPT", "A | chatgpt ", "A — ChatGPT", "A ChatGPT", "ChatGPT", "ChatGPT and A", "A -- ChatGPT")] == ["A", "A", "A", "A", "Shared conversation", "ChatGPT and A", "A -"]


def test_flat_graph_cycles():
    loop = revive([{"_1": 0}, "self"])
    assert loop["self"] is loop
    assert revive([[1, -5, 2], "x", None]) == ["x", None, None]
    for bad in ([{"k": 0}], [[9]], [{"_1": 0}, 5]):
        with pytest.raises(InputError):
            revive(bad)


def test_snapshots(spark):
    good = dom(("user", "hi")).encode()
    import hashlib

    meta = {"schema": "shared-snapshot/0.1", "provider": "chatgpt", "capturedAt": "2024-01-01T00:00:00.000Z", "sourceUrlSha256": "a" * 64, "pageSha256": hashlib.sha256(good).hexdigest(), "byteLength": len(good), "parser": "none", "warning": "w"}
    rows = [(1, good, json.dumps(meta)), (2, good + b" ", json.dumps(meta)), (3, good, json.dumps(meta | {"more": 1})), (4, good, json.dumps(meta | {"provider": "x"}))]
    bad_page = b"<p>nothing</p>"
    rows.append((5, bad_page, json.dumps(meta | {"pageSha256": hashlib.sha256(bad_page).hexdigest(), "byteLength": len(bad_page)})))
    archives, events, bad = snapshots.import_snapshots(spark.createDataFrame(rows, "archive_id long, html_bytes binary, meta string"))
    assert [r.archive_id for r in archives.collect()] == [1] and events.first().content == "hi"
    assert {(r.archive_id, r.rule) for r in bad.collect()} == {(2, "length differs"), (3, "unknown field"), (4, "provider"), (5, "no messages")}
    urls = ["https://chatgpt.com/share/x", "http://chatgpt.com/share/x", "https://chatgpt.com/share/x?y=1", "https://u:p@chatgpt.com/share/x", "https://chatgpt.com:8/share/x", "https://evil.com/share/x", "https://g.co/gemini/share/1", "nonsense"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").coalesce(1)
    assert [r[0] for r in df.select(snapshots.share_provider(F.col("u"))).collect()] == ["chatgpt", None, None, None, None, None, "gemini", None]


def test_markdown_and_archive_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Title\n\n## User\n\nHello\n\n## Assistant\n\nWorld\n", "utf-8")
    archives, events = import_markdown(spark, str(tmp_path / "in"))
    assert [r.content for r in events.orderBy("sequence").collect()] == ["Hello", "World\n"]
    docs = documents.archive_documents(archives.withColumn("created_at", F.lit("2024-01-01T00:00:00.000Z")), events)
    raw = docs.first().raw
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.json").write_text(raw, "utf-8")
    again, events2 = documents.read_archives(spark, str(tmp_path / "out"))
    assert again.first().title == "Title" and events2.count() == 2
    texts = spark.createDataFrame([(1, raw.replace("World", "Word")), (2, raw[:-1] + ',"extra":1}'), (3, raw)], "archive_id long, raw string")
    found = {}
    for r in documents.archive_text_violations(texts).collect():
        found.setdefault(r.archive_id, set()).add(r.rule)
    assert 3 not in found and found[2] == {"unknown field"} and {"transcript hash differs", "content hash differs"} <= found[1]
    doc = json.loads(raw)
    damaged = {
        "archive id": {"archiveId": "arc_x"}, "schema": {"schema": "other/1"}, "title differs": {"title": "Another"}, "capture method": {"capture": doc["capture"] | {"method": "guess", "confidence": "guess"}},
        "capture confidence": {"capture": doc["capture"] | {"confidence": "normalized_json"}}, "source name": {"capture": doc["capture"] | {"sourceName": "a\nb"}}, "encoding": {"transcript": doc["transcript"] | {"encoding": "utf-16"}},
        "normalized source": {"normalizedSource": {"schema": "import/1", "title": "T", "messages": [{"role": "user", "content": "Hello"}]}}, "security": {"security": {"untrustedContent": False, "aiProcessing": "not-used"}},
        "source hash": {"capture": doc["capture"] | {"method": "normalized_json", "confidence": "normalized_json"}}, "shared capture": {"capture": {"method": "public_shared_link", "confidence": "visible_snapshot", "provider": "other"}},
    }
    texts = spark.createDataFrame([(i, json.dumps(doc | change)) for i, change in enumerate(damaged.values())], "archive_id long, raw string")
    found = {}
    for r in documents.archive_text_violations(texts).collect():
        found.setdefault(r.archive_id, set()).add(r.rule)
    assert [rule in found[i] for i, rule in enumerate(damaged)] == [True] * len(damaged)
    tables.write_bundles(docs, archives, str(tmp_path / "bundle"))
    files_ = spark.read.parquet(str(tmp_path / "bundle"))
    assert {r.name for r in files_.collect()} == {"archive.json", "transcript.md", "README.md"}
    assert len(json.loads(tables.checksums(files_).first().checksums)) == 3
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tables.write_bundles(docs, archives, str(tmp_path / "bundle"))


def rules_of(violations, key="archive_id"):
    found = {}
    for r in violations.collect():
        found.setdefault(r[key], set()).add((r.rule, r.subject))
    return found


def test_shapes(spark):
    shape = {"a": "string", "n?": "number", "list": [{"k": "integer", "deep?": {"x": "boolean"}}]}
    good = {"a": "s", "list": []}
    cases = [
        (good, set()), (good | {"n": 1.5}, set()), (good | {"list": [{"k": 1}, {"k": 2, "deep": {"x": True}}]}, set()),
        (good | {"n": 1, "m": {"deep": 1}}, {("unknown field", "$.m")}), (good | {"a": 5}, {("wrong type", "$.a is no string")}), (good | {"a": None}, {("wrong type", "$.a is no string")}),
        (good | {"list": [{"k": 1}, {"k": "1"}, {}, [1]]}, {("wrong type", "$.list[1].k is no integer"), ("missing field", "$.list[2].k"), ("wrong type", "$.list[3] is no object")}),
        (good | {"list": [{"k": 1, "deep": {"x": False, "y": 1}}]}, {("unknown field", "$.list[0].deep.y")}), (good | {"list": {"k": 1}}, {("wrong type", "$.list is no array")}),
        ({}, {("missing field", "$.a"), ("missing field", "$.list")}), ([1], {("wrong type", "$ is no object")}),
    ]
    texts = [(i, json.dumps(doc)) for i, (doc, _) in enumerate(cases)] + [(90, "{bad"), (91, '{"a":"x","a":"y","list":[]}'), (92, None), (93, "")]
    found = rules_of(shape_violations(spark.createDataFrame(texts, "archive_id long, raw string"), shape))
    assert [found.get(i, set()) for i in range(len(cases))] == [want for _, want in cases]
    assert [found.get(i) for i in (90, 91, 92, 93)] == [{("not JSON", "$")}] * 4


def test_forged_archives(spark):
    """Documents that were changed together with their hashes and lengths."""
    imports = spark.createDataFrame([(1, "T", [("user", "Hello"), ("assistant", "```\nopen")], "0" * 64)], "archive_id long, title string, messages array<struct<role:string,content:string>>, source_sha256 string")
    events = project_events(explode_messages(imports))
    archives = imports.join(render_transcripts(events, imports.select("archive_id", "title")), "archive_id").withColumn("created_at", F.lit("2024-01-01T00:00:00.000Z")).withColumn("source_name", F.lit("n"))
    doc = json.loads(documents.archive_documents(archives, events).first().raw)
    text = doc["transcript"]["content"]

    def script(t):
        return {"encoding": "utf-8", "byteLength": len(t.encode()), "sha256": hashlib.sha256(t.encode()).hexdigest(), "content": t}

    source = doc["normalizedSource"]
    shared = {"method": "public_shared_snapshot", "confidence": "visible_snapshot", "provider": "chatgpt", "capture_method": "public_shared_snapshot", "completeness": "visible_snapshot", "hidden_state_available": False, "source_url_sha256": "a" * 64, "source_html_sha256": "b" * 64, "parser": "dom"}
    system = {"messages": [{"role": "system", "content": "Hello"}, source["messages"][1]]}
    cases = [
        ({}, set()),
        ({"transcript": script(text + "More\n")}, {"transcript differs from the source"}),
        ({"transcript": script(text.replace("Hello", "Hullo"))}, {"transcript differs from the source"}),
        ({"title": "Other"}, {"title differs from the source"}),
        ({"security": doc["security"] | {"x": 1}}, {"unknown field"}),
        ({"normalizedSource": source | {"x": 1}}, {"unknown field"}),
        ({"normalizedSource": source | {"schema": "s"}}, {"source schema"}),
        ({"normalizedSource": source | {"messages": []}}, {"source: message count", "events differ from the source"}),
        ({"normalizedSource": source | {"title": ""}}, {"source: title", "title differs from the source", "transcript differs from the source"}),
        ({"events": doc["events"][::-1]}, {"events out of order"}),
        ({"events": [doc["events"][0] | {"x": {}}, doc["events"][1]]}, {"unknown field"}),
        ({"capture": shared}, set()),
        ({"capture": shared, "normalizedSource": None}, {"wrong type", "normalized source"}),
        ({"capture": shared, "normalizedSource": source | system}, {"role not shown", "transcript differs from the source", "events differ from the source"}),
    ]
    texts = [(i, json.dumps(doc | change)) for i, (change, _) in enumerate(cases)]
    texts.append((50, json.dumps({k: v for k, v in (doc | {"capture": shared}).items() if k != "normalizedSource"})))
    found = rules_of(documents.archive_text_violations(spark.createDataFrame(texts, "archive_id long, raw string")))
    assert [{rule for rule, _ in found.get(i, set())} for i in range(len(cases))] == [want for _, want in cases]
    assert {rule for rule, _ in found[50]} == {"normalized source"}


def test_files_of_no_bytes_are_not_passed_over(spark, tmp_path):
    (tmp_path / "a b%41é.json").write_text("x")
    (tmp_path / "é c%.json").write_text("")
    got = {r.path.rsplit("/", 1)[1]: r.problem for r in documents.read_texts(spark, str(tmp_path / "*.json")).collect()}
    assert got == {"a b%41é.json": None, "é c%.json": "empty"}
    with pytest.raises(Exception, match="not a non-empty UTF-8 text"):
        import_markdown(spark, str(tmp_path))[0].collect()


def test_sidecars(spark, tmp_path):
    events = project_events(spark.createDataFrame([(n, 0, "user", "x") for n in range(1, 9)], "archive_id long, sequence int, role string, content string"))
    event = {r.archive_id: r.event_id for r in events.collect()}
    side = lambda n, **more: {"schema": "annotations/1", "archiveId": f"arc_{n}", "items": [{"eventId": event[n], "kind": "pin", "note": "n", "createdAt": "2024-01-01T00:00:00Z"}]} | more
    (tmp_path / "a").mkdir()
    texts = {
        1: json.dumps(side(1)).encode(), 3: b"", 4: b" \n", 5: b"{cut", 6: b"\xff\xfe", 7: json.dumps(side(7, archiveId="arc_1", more=1)).encode(), 8: json.dumps(side(8) | {"items": [{"eventId": "evt_0", "kind": "odd", "note": "n" * 2001, "createdAt": "soon"}]}).encode(), 9: json.dumps(side(1)).encode(),
    }
    for n, text in texts.items():
        (tmp_path / "a" / f"{n}.json.annotations.json").write_bytes(text)
    archives = spark.createDataFrame([(f"file://{tmp_path}/a/{n}.json", n, f"arc_{n}") for n in range(1, 9)], "key string, archive_id long, stored_id string").withColumn("key", files.file_key(F.col("key")))
    states = documents.sidecar_states(archives, documents.load_sidecars(spark, str(tmp_path / "a" / "*.annotations.json")))
    assert {r.archive_id: r.state for r in states.collect()} == {1: "read", 2: "missing", 3: "empty", 4: "empty", 5: "unreadable", 6: "unreadable", 7: "read", 8: "read", None: "stray"}
    notes, bad = documents.read_annotations(states, events)
    assert {(r.archive_id, r.event_id) for r in notes.collect()} == {(1, event[1]), (7, event[7]), (8, "evt_0")}
    found = {a: {rule for rule, _ in rules} for a, rules in rules_of(bad).items()}
    assert found == {3: {"sidecar empty"}, 4: {"sidecar empty"}, 5: {"sidecar unreadable"}, 6: {"sidecar unreadable"}, 7: {"sidecar of another archive", "unknown field"}, 8: {"unknown event", "kind", "note", "created_at"}, None: {"sidecar stray"}}


def test_imports(spark, tmp_path):
    good = {"schema": "s", "title": "T", "messages": [{"role": "user", "content": "## User\nliteral"}, {"role": "assistant", "content": "ok"}]}
    (tmp_path / "g.json").write_text(json.dumps(good))
    archives, events, bad = documents.import_json(spark, str(tmp_path / "g.json"))
    assert bad.count() == 0 and events.count() == 2 and "## User\nliteral" in archives.first().transcript
    cases = [json.dumps(good | {"x": 1}), json.dumps(good | {"title": "a\nb"}), json.dumps(good | {"messages": []}), json.dumps(good | {"messages": [{"role": "boss", "content": "x"}]}), json.dumps(good | {"messages": [{"role": "user", "content": "x", "y": 1}]}), "[1]", json.dumps(good | {"messages": [{"role": "user", "content": "x" * (4 << 20)}, {"role": "user", "content": "y"}]})]
    _, bad = documents.parse_imports(spark.createDataFrame(list(enumerate(cases)), "archive_id long, raw string"))
    rules = {}
    for r in bad.collect():
        rules.setdefault(r.archive_id, set()).add(r.rule)
    assert [rules[i] for i in (0, 1, 2, 3, 4, 6)] == [{"unknown field"}, {"title"}, {"message count"}, {"role unknown"}, {"unknown field"}, {"too large"}] and "not a JSON object" in rules[5]
    (tmp_path / "b.json").write_text(cases[1])
    with pytest.raises(InputError):
        documents.import_json(spark, str(tmp_path / "b.json"))


def test_packages():
    entries = [("manifest.json", b"{}"), ("archive.json", b"{}"), ("index.json", b"x" * 100)]
    raw = packages.write_stored(entries)
    assert [(n, d) for n, d, _ in packages.read_stored(raw, packages.ENTRIES)] == entries
    assert packages.read_stored(raw)[2][2] == zlib.crc32(b"x" * 100)
    flagged = bytearray(raw)
    flagged[6] = 1
    for bad in (raw[:-1], raw + b"x", bytes(flagged), raw.replace(b"x" * 100, b"y" + b"x" * 99), b""):
        with pytest.raises(InputError):
            packages.read_stored(bad, packages.ENTRIES)
    with pytest.raises(InputError):
        packages.read_stored(packages.write_stored(entries[::-1]), packages.ENTRIES)


def test_package_frames(spark):
    f = spark.createDataFrame([(1, "archive.json", bytearray(b"{}")), (1, "index.json", bytearray(b"[]"))], "archive_id long, name string, data binary")
    got = packages.read_packages(packages.pack_archives(f))
    assert {(r.name, bytes(r.data)) for r in got.collect()} == {("archive.json", b"{}"), ("index.json", b"[]")}
    m = spark.createDataFrame([(1, "archive.json", 2, "0" * 64), (1, "gone", 1, "1" * 64)], "archive_id long, path string, byteLength int, sha256 string")
    assert {r.rule for r in packages.manifest_violations(got, m).collect()} == {"differs", "listed only", "not listed"}
    assert json.loads(packages.manifests(got).first().manifest)["files"][0]["path"] == "archive.json"


def test_envelopes(spark):
    a = spark.createDataFrame([(1, bytearray(b"secret text"))], "archive_id long, content binary")
    e = spark.createDataFrame(envelopes.encrypt(a, b"a long passphrase").collect(), "archive_id long, envelope string")
    assert bytes(envelopes.decrypt(e, b"a long passphrase").first().content) == b"secret text"
    assert envelopes.decrypt(e, b"another passphrase").first().error == "wrong passphrase or altered"
    weak = e.withColumn("envelope", F.regexp_replace("envelope", '"N":16384', '"N":2'))
    assert envelopes.decrypt(weak, b"a long passphrase").first().error == "unsupported envelope"
    with pytest.raises(InputError):
        envelopes.encrypt(a, b"short")


def test_rows_of_a_table_share_derivations(spark):
    a = spark.range(300).repartition(2).select(F.col("id").alias("archive_id"), F.encode(F.concat(F.lit("text "), "id"), "UTF-8").alias("content"))
    e = spark.createDataFrame(envelopes.encrypt(a, b"a long passphrase").collect(), "archive_id long, envelope string")
    part = lambda path: F.count_distinct(F.get_json_object("envelope", path))
    salts, nonces = e.select(part("$.kdf.salt"), part("$.cipher.nonce")).first()
    assert salts <= 4 and nonces == 300
    assert {(r.archive_id, bytes(r.content)) for r in envelopes.decrypt(e, b"a long passphrase").collect()} == {(i, b"text %d" % i) for i in range(300)}
    own = spark.createDataFrame(envelopes.encrypt(a.limit(5), b"a long passphrase", rows_per_salt=1).collect(), e.schema)
    assert own.select(part("$.kdf.salt")).first()[0] == 5
    assert envelopes.decrypt(own.unionByName(e), b"a long passphrase").filter("error is not null").count() == 0


def test_many_files_are_read_folder_by_folder(spark, tmp_path, monkeypatch):
    spark.range(12).selectExpr("id as conv_id", "0 as turn", "'user' as role", "concat('text ', id) as text").write.parquet(str(tmp_path / "conversations.parquet"))
    names, read = [], files.empty_files
    monkeypatch.setattr(files, "FILES_AT_ONCE", 3, raising=False)
    monkeypatch.setattr(files, "empty_files", lambda r: (names.append(len(r.inputFiles())), read(r))[1])
    rows = queries()["file_texts"](spark, str(tmp_path)).collect()
    assert sorted(r.archive_id for r in rows) == list(range(12)) and all(r.below and r.problem is None for r in rows)
    assert sum(names) == 12 and max(names) < 12


def test_registry(spark):
    ok = {"schema": "m", "id": "my-adapter", "name": "N", "version": "1.0.0", "inputFormat": "f", "capabilities": ["normalize-only"], "securityContact": "c"}
    _, bad = documents.parse_registry(spark, json.dumps({"schema": "r", "adapters": [ok]}), "f")
    assert bad.count() == 0
    rows, bad = documents.parse_registry(spark, json.dumps({"schema": "r", "adapters": [ok, ok, ok | {"id": "B"}, ok | {"id": "cc", "run": "x"}, ok | {"id": "dd", "capabilities": []}]}), "f")
    assert rows.count() == 5 and sorted(r.rule for r in bad.collect()) == ["capabilities", "id", "id repeated", "unknown field"]


def test_projects(spark):
    doc = {"schema": "p", "projectId": "prj_1", "name": "N", "createdAt": "t", "archives": [{"id": "a", "path": "a.json", "title": "T", "transcriptSha256": "0", "archiveSha256": "1"}], "artifacts": [], "edges": [{"from": "a", "to": "b", "kind": "related"}], "claims": []}
    got = documents.parse_projects(spark.createDataFrame([(1, json.dumps(doc))], "archive_id long, raw string"))
    assert got["violations"].count() == 0 and got["members"].first().archive_id == "a" and got["edges"].first().to_id == "b" and got["claims"].count() == 0
    doc["edges"][0]["weight"] = 1
    assert [r.subject for r in documents.parse_projects(spark.createDataFrame([(1, json.dumps(doc))], "archive_id long, raw string"))["violations"].collect()] == ["weight"]


def test_forged_projects(spark, tmp_path):
    name = lambda kind, n: f"{kind}_00000000-0000-0000-0000-{n:012d}"
    digest, time = "c" * 64, "2024-01-01T00:00:00.000Z"
    doc = {
        "schema": "project/1", "projectId": name("prj", 1), "name": "N", "createdAt": time,
        "archives": [{"id": name("arc", n), "path": f"a/{n}.json", "title": "T", "transcriptSha256": digest, "archiveSha256": digest} for n in (1, 2)],
        "artifacts": [{"id": name("art", 1), "kind": "file", "path": "f", "name": "f", "sha256": digest}, {"id": name("art", 2), "kind": "repository", "path": "r", "name": "r", "head": "d" * 40}],
        "edges": [{"from": name("arc", 1), "to": name("art", 1), "kind": "supports"}],
        "claims": [{"id": name("clm", 1), "archiveId": name("arc", 1), "eventId": "evt_0001_0123456789ab", "kind": "task", "note": "n", "createdAt": time}],
    }

    def change(part, i, **fields):
        rows = [dict(r) for r in doc[part]]
        rows[i] |= fields
        return {part: rows}

    cases = [
        ({}, set()), ({"claims": doc["claims"] * 2}, {"claim repeated"}), (change("claims", 0, eventId="evt_1_0123456789ab"), {"claim event"}), (change("claims", 0, createdAt="soon"), {"claim created_at"}), (change("claims", 0, note="a\tb"), {"claim"}),
        (change("artifacts", 0, kind="link"), {"artifact kind"}), (change("artifacts", 0, sha256="C" * 64), {"file hash"}), (change("artifacts", 1, head="d" * 39), {"repository head"}), (change("artifacts", 1, path="/r"), {"artifact path"}), (change("artifacts", 1, name="x" * 161), {"artifact name"}),
        (change("archives", 0, path="a/../b"), {"archive path"}), (change("archives", 0, title=""), {"archive title"}), (change("archives", 1, archiveSha256="0"), {"archive_sha256 format"}), (change("archives", 1, extra=[1]), {"unknown field"}), (change("archives", 1, title=1), {"wrong type"}),
        ({"name": "x" * 121}, {"name"}), ({"createdAt": "soon"}, {"created_at"}), ({"schema": "project/2"}, {"schema"}), ({"projectId": "prj_2"}, {"project id"}), (change("edges", 0, to=name("art", 9)), {"unknown end"}),
    ]
    for i, (changes, want) in enumerate(cases):
        cases[i] = (doc | {"projectId": name("prj", i)} | changes, want)
    texts = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)], "archive_id long, raw string")
    found = rules_of(documents.project_text_violations(texts), "project_id")
    assert [{rule for rule, _ in found.get(d["projectId"], set())} for d, _ in cases] == [want for _, want in cases]
    (tmp_path / "p.json").write_text(json.dumps(cases[1][0]))
    with pytest.raises(InputError, match="claim repeated"):
        documents.read_projects(spark, str(tmp_path / "p.json"))


def test_files_and_heads(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("hi")
    r = files.file_artifacts(spark, str(tmp_path / "d"), str(tmp_path)).first()
    assert (r.path, r.name) == ("d/f.txt", "f.txt")
    git = tmp_path / "repo" / ".git" / "refs" / "heads"
    git.mkdir(parents=True)
    (git / "main").write_text("a" * 40 + "\n")
    head = tmp_path / "repo" / ".git" / "HEAD"
    head.write_text("ref: refs/heads/main\n")
    assert files.git_head(str(tmp_path / "repo")) == "a" * 40
    for bad in ("ref: refs/../x", "ref: refs/heads/none", "zzz"):
        head.write_text(bad)
        with pytest.raises(InputError):
            files.git_head(str(tmp_path / "repo"))
    df = spark.createDataFrame([(p,) for p in ("a/b", "/a", "a//b", "../a", "a/./b", "a\tb", "")], "p string").coalesce(1)
    assert [r[0] for r in df.select(files.is_relative_path(F.col("p"))).collect()] == [True] + [False] * 6


def test_sinks(spark, tmp_path):
    e = project_events(spark.createDataFrame([(1, 0, "user", "b a"), (2, 0, "user", "a")], "archive_id long, sequence int, role string, content string"))
    from scriptorium.operators import index

    i = index.postings(index.event_terms(e))
    for _ in range(2):
        tables.write_index(i, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).exceptAll(i).count() == 0
    a = e.filter("archive_id = 1").first().event_id
    schema = "archive_id long, pos int, event_id string, kind string, note string, created_at string"
    old = spark.createDataFrame([(1, 4, a, "pin", "n", "2024-01-01T00:00:00Z")], schema)
    new = spark.createDataFrame([(1, a, "pin", "m", "2024-01-02T00:00:00Z")], "archive_id long, event_id string, kind string, note string, created_at string")
    assert sorted(r.pos for r in tables.add_annotations(old, new, e).collect()) == [4, 5]
    with pytest.raises(InputError):
        tables.add_annotations(old, new.withColumn("note", F.lit("")), e)
    tables.write_json_lines(e.select("archive_id"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 2


def test_recorder(spark, tmp_path):
    rows = [(1, 0, "user", "aaaa"), (1, 1, "assistant", "x" * 50), (1, 2, "user", "bbbb"), (1, 3, "user", "cc"), (1, 4, "user", "d"), (2, 0, "odd", "x")]
    m = spark.createDataFrame(rows, "archive_id long, sequence int, role string, content string")
    batch = {(r.archive_id, r.sequence): r.accepted for r in recorder_caps(m, 20, 3, 9).collect()}
    assert [batch[1, i] for i in range(5)] == [True, False, True, False, False]
    m.write.parquet(str(tmp_path / "in"))
    q = record_stream(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")), 3, 9, 20).writeStream.format("memory").queryName("recorded").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.archive_id, r.sequence): (r.accepted, r.reason) for r in spark.table("recorded").collect()}
    assert got == {(1, 0): (True, None), (1, 1): (False, "message"), (1, 2): (True, None), (1, 3): (False, "full"), (1, 4): (True, None), (2, 0): (False, "message")}
