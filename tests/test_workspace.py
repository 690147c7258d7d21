import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.model import InputError
from scriptorium.operators.mutations import BATCH, Caps
from scriptorium.sources.remote import Answer
from scriptorium.workspace import COMMANDS, Workspace

NOW = "2024-01-01T00:00:00.000Z"


def test_from_import_to_handoff(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Alpha\n\n## User\n\nShall we use PKCE?\n\n## Assistant\n\nPKCE is the decision.\n\n## User\n\nThanks\n", "utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"schema": "s", "title": "Beta", "messages": [{"role": "user", "content": "PKCE again"}]}))
    w = Workspace(spark, str(tmp_path / "ws"))
    a = w.import_markdown(str(tmp_path / "in"), NOW).first().archive_id
    b = w.import_json(str(tmp_path / "b.json"), NOW).first().archive_id
    w.import_markdown(str(tmp_path / "in"), NOW)  # again: nothing new
    assert w.inspect().count() == 4 and w.verify().count() == 0 and w.verify_index().count() == 0
    assert w.search("pkce decision").count() == 1 and w.search("PKCE", scan=True).count() == 3
    e = {r.sequence: r.event_id for r in w.inspect(a).collect()}
    w.annotate(spark.createDataFrame([(a, e[1], "decision", "PKCE", NOW)], "archive_id long, event_id string, kind string, note string, created_at string"))
    packets = {r.archive_id: r for r in w.continue_().collect()}
    assert packets[a].event_ids == e[1] and "PKCE again" in packets[b].packet
    assert "Shall we" in w.handoff("decision", archive_id=a).first().handoff
    with pytest.raises(InputError):
        w.continue_("x", w.table("annotations"))
    assert "rubric" in w.evaluate_handoff("decision", "rubric?", a).first().instructions
    w.build_graph()
    w.link(spark.createDataFrame([(a, e[0], e[1], "answers")], "archive_id long, from_id string, to_id string, kind string"))
    assert w.verify_graph().count() == 0
    with pytest.raises(InputError):
        w.link(spark.createDataFrame([(a, e[1], e[0], "answers")], "archive_id long, from_id string, to_id string, kind string"))
    assert "answers" in w.brief(a).first().brief and "<svg" in w.graph_viewer(archive_id=a).first().html and "Thanks" in w.viewer(a).first().html
    assert w.plan("ollama", "m", "summary", archive_id=a).first().over_limit is False

    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.pack").write_bytes(bytes(w.export_packages(a).first().content))
    other = Workspace(spark, str(tmp_path / "other"))
    other.import_packages(str(tmp_path / "out"), NOW)
    assert sorted(r.event_id for r in other.inspect().collect()) == sorted(e.values())
    sealed = spark.createDataFrame(w.encrypt(b"long enough phrase", a).collect(), "archive_id long, envelope string")
    assert json.loads(bytes(w.decrypt(sealed, b"long enough phrase").first().content))["title"] == "Alpha"

    w.new_project("p", "Project", NOW)
    w.add_archives("p", [a, b])
    w.link_nodes(spark.createDataFrame([("p", str(max(a, b)), str(min(a, b)), "related")], "project_id string, from_id string, to_id string, kind string"))
    w.claim(spark.createDataFrame([("p", "c1", a, e[1], "decision", "use it")], "project_id string, claim_id string, archive_id long, event_id string, kind string, note string"))
    with pytest.raises(InputError):
        w.claim(spark.createDataFrame([("p", "c2", a, "evt_no", "decision", "x")], "project_id string, claim_id string, archive_id long, event_id string, kind string, note string"))
    assert w.verify_projects()[1].first().valid
    assert [r.title for r in w.search_projects("PKCE").orderBy("rank").collect()] == ["Alpha", "Alpha", "Beta"]
    assert "use it" in w.continue_projects("PKCE").first().handoff
    w._write("archives", w.table("archives").withColumn("transcript_sha256", F.lit("0" * 64)))
    with pytest.raises(InputError):
        w.search_projects("PKCE")


def test_shared_pages(spark, tmp_path):
    def get(url, timeout, row):
        return Answer(404 if url.endswith("gone") else 200, {"content-type": "text/html"}, iter([b'<article data-message-author-role="user"><p>Hi</p></article>']))

    w = Workspace(spark, str(tmp_path / "ws"))
    urls = spark.createDataFrame([(1, "https://chatgpt.com/share/a"), (2, "https://chatgpt.com/share/gone")], "archive_id long, url string")
    assert {r.archive_id: r.error for r in w.fetch_shared(urls, get, str(tmp_path / "pages"), NOW).collect()} == {1: None, 2: "status 404"}
    assert [r.archive_id for r in spark.read.parquet(str(tmp_path / "pages")).collect()] == [1]
    with pytest.raises(InputError, match="status 404"):
        w.import_shared(urls, get, NOW)
    w.import_shared(urls.limit(1), get, NOW)
    assert w.inspect().count() == 1 and w.search("hi").count() == 1


def one_by_one(events, hashes, batch, caps):
    """The operations in turn on dictionaries."""
    projects, members, artifacts, edges, claims, notes, out = {}, {}, {}, set(), set(), {}, {}
    for r in sorted((r for r in batch if r["seq"] is not None), key=lambda r: r["seq"]):
        op, p, rule = r["op"], r.get("project_id"), None
        of = lambda rows: sum(k[0] == p for k in rows)  # noqa: B023, E731
        if sum(x["seq"] == r["seq"] for x in batch) > 1:
            rule = "order"
        elif op == "project":
            rule = "name" if not r.get("name") else "created_at" if r.get("created_at") != NOW else "repeated" if p in projects else projects.update({p: 1})
        elif op == "member":
            a = r["archive_id"]
            rule = "unknown project" if p not in projects else "unknown archive" if a not in hashes else "repeated" if (p, a) in members else "too many" if of(members) >= caps.members else members.update({(p, a): 1})
        elif op == "artifact":
            rule = "unknown project" if p not in projects else "path" if ".." in r["path"] else "hash" if not r.get("sha256") else "repeated" if (p, r["id"]) in artifacts else "too many" if of(artifacts) >= caps.artifacts else artifacts.update({(p, r["id"]): 1})
        elif op == "edge":
            f, t = (r["from_id"], r["to_id"]) if r["kind"] != "related" else sorted((r["from_id"], r["to_id"]))
            nodes = {(q, str(x)) for q, x in [*members, *artifacts]}
            rule = "edge kind" if r["kind"] == "odd" else "unknown end" if not {(p, f), (p, t)} <= nodes else "loop" if f == t else "repeated" if (p, f, t, r["kind"]) in edges else "too many" if of(edges) >= caps.edges else edges.add((p, f, t, r["kind"]))
        elif op == "claim":
            rule = "archive not valid" if (p, r["archive_id"]) not in members else "unknown event" if (r["archive_id"], r["event_id"]) not in events else "kind" if r["kind"] != "task" else "note" if not r["note"] else "repeated" if (p, r["id"]) in claims else "too many" if of(claims) >= caps.claims else claims.add((p, r["id"]))
        elif op == "annotation":
            a = r["archive_id"]
            rule = "unknown event" if (a, r["event_id"]) not in events else "kind" if r["kind"] != "pin" else "note" if not r["note"] else "too many" if len(notes.get(a, ())) >= caps.annotations else notes.setdefault(a, []).append(r["event_id"])
        else:
            rule = "operation"
        out[r["seq"]] = rule
    return out, members, edges, claims, notes


def test_batches_are_their_operations_in_turn(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(4):
        (tmp_path / "in" / f"{n}.md").write_text(f"# T{n}\n\n## User\n\none {n}\n\n## Assistant\n\ntwo {n}\n", "utf-8")
    w = Workspace(spark, str(tmp_path / "ws"))
    hashes = {r.archive_id: r.transcript_sha256 for r in w.import_markdown(str(tmp_path / "in"), NOW).collect()}
    known = {(r.archive_id, r.event_id) for r in w.inspect().collect()}
    rng, archives, events = random.Random(8), [*hashes, 99], [*known, (99, "evt_0"), (next(iter(hashes)), "evt_0")]
    caps = Caps(members=3, artifacts=2, edges=3, claims=3, annotations=3)

    def some(seq):
        op = rng.choices(["project", "member", "artifact", "edge", "claim", "annotation", "odd"], [1, 5, 3, 8, 5, 5, 1])[0]
        a, e = rng.choice(events)
        end = lambda: rng.choice([str(x) for x in [*archives, "f1", "f2", "f3"]])
        row = {"seq": seq, "op": op, "project_id": rng.choice("pq"), "created_at": rng.choice([NOW] * 5 + ["soon"]), "archive_id": a, "note": rng.choice(["n", "n", "n", ""])}
        own = {
            "project": {"name": rng.choice(["N", "N", ""])}, "member": {"archive_id": rng.choice(archives)}, "artifact": {"id": rng.choice(["f1", "f2", "f3"]), "path": rng.choice(["a/b", "a/b", "../b"]), "name": "n", "sha256": rng.choice(["a" * 64, "a" * 64, None])},
            "edge": {"from_id": end(), "to_id": end(), "kind": rng.choice(["related", "supports", "odd"])}, "claim": {"id": rng.choice("wxyz"), "event_id": e, "kind": rng.choice(["task", "task", "pin"])}, "annotation": {"event_id": e, "kind": rng.choice(["pin", "pin", "task"]), "created_at": NOW},
        }
        return row | own.get(op, {})

    batch = [{"seq": 0, "op": "project", "project_id": "p", "name": "N", "created_at": NOW}] + [some(i) for i in range(1, 130)] + [some(131), some(131), some(132) | {"seq": None}]
    fields = [c.split()[0] for c in BATCH.split(", ")]
    # in two batches, the second on what the first has stored
    parts = [[r for r in batch if r["seq"] is not None and r["seq"] < 60], [r for r in batch if r["seq"] is None or r["seq"] >= 60]]
    got = {}
    for part in parts:
        df = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in part], BATCH)
        verdicts = w.apply(df, caps).collect()
        assert len(verdicts) == len(part)
        got |= {r.seq: r.rule for r in verdicts}
    want, members, edges, claims, notes = one_by_one(known, hashes, batch, caps)
    assert got.pop(None) == "order" and got == want
    assert {(r.project_id, r.archive_id) for r in w.table("members").collect()} == set(members) and {(r.project_id, r.claim_id) for r in w.table("claims").collect()} == claims
    assert {(r.project_id, r.from_id, r.to_id, r.kind) for r in w.table("edges").collect()} == edges
    stored = {}
    for r in w.table("annotations").orderBy("pos").collect():
        stored.setdefault(r.archive_id, []).append((r.pos, r.event_id))
    assert stored == {a: list(enumerate(v)) for a, v in notes.items()}
    assert {"repeated", "too many", "unknown end", "loop", "unknown project", None} <= set(want.values())


def test_commands_name_methods():
    assert all(callable(getattr(Workspace, m)) for m in COMMANDS.values())
