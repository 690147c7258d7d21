import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.tokens import query_terms
from scriptorium.model import InputError
from scriptorium.operators import briefs, evidence, graph, index, integrity, planning, projects, search
from scriptorium.operators.canonical import canonical_json
from scriptorium.operators.projection import project_events
from scriptorium.sinks import tables

MESSAGES = "archive_id long, sequence int, role string, content string"


def events_of(spark, *archives):
    rows = [(a + 1, i, r, c) for a, messages in enumerate(archives) for i, (r, c) in enumerate(messages)]
    return project_events(spark.createDataFrame(rows, MESSAGES))


def talk(*texts):
    return [(("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]


def ids(events, archive=1):
    return [r.event_id for r in events.filter(F.col("archive_id") == archive).orderBy("sequence").collect()]


def test_two_searches_differ(spark):
    e = events_of(spark, talk("the blue house", "a house, the Blue one", "nothing"), talk("blue"))
    i = index.postings(index.event_terms(e))
    got = search.search_terms(e, i, "blue the").orderBy("archive_id", "sequence").collect()
    assert [(r.archive_id, r.sequence, r.score) for r in got] == [(1, 0, 2), (1, 1, 2)]
    assert [(r.archive_id, r.sequence) for r in search.search_scan(e, "Blue House").collect()] == [(1, 0)]
    assert search.search_terms(e, i, "blue absent").collect() == []


def test_batch_search_equals_single_searches(spark):
    events = events_of(spark, talk("PKCE decision here", "the decision", "Ｐkce and ﬁne decision"), talk("nothing", "pkce, decision: PKCE"))
    i = index.postings(index.event_terms(events))
    asked = ["pkce decision", "decision", "ﬁne", "fine pkce", "absent", "nothing"]
    refused = [None, "", "a\nb", "---", "x" * 257, " ".join(f"t{n}" for n in range(17)), "y" * 129]
    queries = spark.createDataFrame(list(enumerate([*asked, *refused])), "query_id int, query string")
    want = sorted((n, *r) for n, q in enumerate(asked) for r in search.search_terms(events, i, q).collect())
    for rows in (100_000, 0):  # a broadcast side, and a shuffled one
        assert sorted(tuple(r) for r in search.search_batch(events, i, queries, rows).collect()) == want
    bad = {r.query_id: r.rule for r in search.query_violations(queries).collect()}
    assert set(bad) == set(range(len(asked), len(asked) + len(refused)))
    for q in [*asked, *refused]:
        if q is not None:
            try:
                query_terms(q)
                sound = True
            except InputError:
                sound = False
            assert sound == (q in asked)


def test_bucketed_tables_are_joined_without_a_shuffle(spark, tmp_path):
    events = events_of(spark, *[talk("pkce decision", f"the {n}", "decision") for n in range(9)])
    i = index.postings(index.event_terms(events))
    a, b = tables.write_bucketed(i, str(tmp_path / "i"), 4, ["term"]), tables.write_bucketed(events, str(tmp_path / "e"), 4, ["sequence"])
    again = tables.open_bucketed(spark, "archive_id long, term string, event_ids array<string>", str(tmp_path / "i"), 4, ["term"])
    want = sorted(tuple(r) for r in search.search_terms(events, i, "decision pkce").collect())
    for stored in (a, again):
        hits = search.search_bucketed(b, stored, "decision pkce")
        assert sorted(tuple(r) for r in hits.collect()) == want and len(want) == 9
        assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()


def test_snippets(spark):
    text = "x " * 100 + "needle\r\nnext " + "y" * 300
    e = events_of(spark, talk(text))
    got = search.search_terms(e, index.postings(index.event_terms(e)), "needle").first().snippet
    at = text.index("needle")
    assert got == "…" + text[at - 100 : at + 180].replace("\r\n", " ") + "…"
    assert search.search_scan(e, "needle").first().snippet == "…" + text[at - 100 : at + 6 + 180].replace("\r\n", " ") + "…"


def test_index_is_stable_and_checked(spark):
    e = events_of(spark, talk("b a b", "a c"), talk("z"))
    i = index.postings(index.event_terms(e))
    shuffled = index.postings(index.event_terms(e.orderBy(F.rand(3))))
    assert i.exceptAll(shuffled).count() == 0
    first = ids(e)
    assert {r.term: r.event_ids for r in i.filter("archive_id = 1").collect()} == {"a": first, "b": first[:1], "c": first[1:]}
    assert index.index_differences(i, e).count() == 0
    assert [(r.term, r.side) for r in index.index_differences(i.filter("term <> 'c'"), e).collect()] == [("c", "missing")]
    bad = i.withColumn("pos", F.lit(0)).withColumn("event_ids", F.array(F.lit("evt_0001_0"), F.lit("evt_0001_0")))
    rules = {r.rule for r in integrity.index_violations(bad.filter("archive_id = 2"), e).collect()}
    assert rules == {"posting repeated", "unknown event"}


def window_by_steps(anchors, n, limit):
    chosen = []
    for s in anchors:
        for o in (0, -1, 1):
            if 0 <= s + o < n and s + o not in chosen and len(chosen) < limit:
                chosen.append(s + o)
    return sorted(chosen)


def test_windows_and_budgets_equal_a_sequential_statement(spark):
    rng = random.Random(5)
    archives = [talk(*["é" * rng.randint(0, 12) for _ in range(rng.randint(1, 12))]) for _ in range(60)]
    e = events_of(spark, *archives).cache()
    anchors, want = [], set()
    for a, m in enumerate(archives):
        picks = rng.sample(range(len(m)), min(len(m), rng.randint(1, 4)))
        anchors += [(a + 1, s, r + 1) for r, s in enumerate(picks)]
        want |= {(a + 1, s) for s in window_by_steps(picks, len(m), 5)}
    got = evidence.expand_window(spark.createDataFrame(anchors, "archive_id long, sequence int, rank int"), e, 5)
    assert {(r.archive_id, r.sequence) for r in got.collect()} == want
    with pytest.raises(ValueError):
        evidence.expand_window(got, e, 21)

    budget = 25
    heads = {(r.archive_id, r.sequence): (r.state, r.excerpt) for r in evidence.head_budget(e, budget, excerpts=True).collect()}
    tails = {(r.archive_id, r.sequence): r.excerpt for r in evidence.raw_tail(e, budget, excerpts=True).collect()}
    for a, m in enumerate(archives):
        left = budget
        for s, (_, c) in enumerate(m):
            size = len(c.encode())
            if left <= 0:
                assert heads[a + 1, s] == ("omitted", None)
            elif size <= left:
                assert heads[a + 1, s] == ("full", c)
                left -= size
            else:
                assert heads[a + 1, s] == ("truncated", c.encode()[:left].decode("utf-8", "ignore"))
                left = 0
        left, mine = budget, {}
        for s in range(len(m) - 1, -1, -1):
            c = m[s][1]
            if len(c.encode()) <= left:
                mine[s] = c
                left -= len(c.encode())
                continue
            if left > 0:
                mine[s] = c.encode()[-left:].decode("utf-8", "ignore")
            break
        assert {s: x for (b, s), x in tails.items() if b == a + 1} == mine


def test_evidence_union_order(spark):
    chosen = spark.createDataFrame([(1, "e3", 0), (1, "e1", 1)], "archive_id long, event_id string, pos int")
    notes = spark.createDataFrame([(1, "e2", 0), (1, "e3", 1), (1, "e9", 2)], "archive_id long, event_id string, pos int")
    got = evidence.evidence_union(chosen, notes, 3).orderBy("rank").collect()
    assert [(r.event_id, r.rank) for r in got] == [("e3", 1), ("e1", 2), ("e2", 3)]


def test_prompt_packing(spark):
    e = events_of(spark, talk("a" * 50, "b" * 50, "c"), talk("z" * 500, "y"))
    got = evidence.pack_prompt(e, 270, 20).orderBy("archive_id", "sequence").collect()
    assert [(r.archive_id, r.sequence, r.cut) for r in got] == [(1, 0, False), (1, 1, False), (2, 0, True)]


def test_graph(spark):
    e = events_of(spark, talk("a", "b", "c"))
    a, b, c = ids(e)
    rows = [(1, a, b, "answers"), (1, c, a, "supports"), (1, a, "evt_x", "supports"), (1, a, c, "odd"), (1, b, c, "answers"), (1, b, c, "answers")]
    m = spark.createDataFrame(rows, "archive_id long, from_id string, to_id string, kind string")
    found = sorted((r.problem or "") for r in graph.manual_edges(m, e).collect())
    assert found == ["", "kind", "not forward", "repeated", "repeated", "unknown event"]
    g = graph.build_graph(e, m)
    assert [(r.from_id, r.to_id, r.kind) for r in g.orderBy("part", "rank").collect()][:2] == [(a, b, "next"), (b, c, "next")]
    sound = graph.build_graph(e, m.limit(1))
    assert graph.graph_differences(sound, e).count() == 0
    assert graph.rebuild_graph(sound, e).exceptAll(sound).count() == 0
    assert graph.graph_differences(sound.filter("kind <> 'next'"), e).filter("side = 'missing'").count() == 2
    assert graph.inventory(e, sound).first()[1:] == (3, 2, 1)
    assert [r.role for r in graph.role_counts(e).orderBy("rank").collect()] == ["user", "assistant"]


def test_event_integrity(spark):
    e = events_of(spark, talk("a", "b", "c"))
    assert integrity.event_violations(e).count() == 0
    changed = e.withColumn("content", F.when(F.col("sequence") == 1, "B").otherwise(F.col("content")))
    assert {r.rule for r in integrity.event_violations(changed).collect()} == {"event id differs", "content hash differs"}
    assert {r.rule for r in integrity.event_violations(e.filter("sequence <> 1")).collect()} == {"sequence broken"}
    with pytest.raises(InputError):
        integrity.require_none(integrity.event_violations(changed), "events")


def test_annotations(spark):
    e = events_of(spark, talk("a"))
    (a,) = ids(e)
    rows = [(1, 0, a, "pin", "note", "2024-01-01T00:00:00.000Z"), (1, 1, "evt_no", "pin", "x", "2024-01-01T00:00:00.000Z"), (1, 2, a, "odd", "", "never"), (1, 3, a, "pin", "n" * 2001, "2024-01-01T00:00:00.000Z")]
    bad = integrity.annotation_violations(spark.createDataFrame(rows, "archive_id long, pos int, event_id string, kind string, note string, created_at string"), e, adding=True)
    assert sorted((r.subject, r.rule) for r in bad.collect()) == [("1", "unknown event"), ("2", "created_at"), ("2", "kind"), ("2", "note"), ("3", "note")]


def archives_of(spark, e):
    return e.select("archive_id").distinct().select("archive_id", F.lit("T <1>").alias("title"), F.lit("0" * 64).alias("transcript_sha256"), F.lit("user_supplied").alias("confidence"))


def notes_of(spark, e, n=1):
    rows = [(1, i, x, "decision", f"note {i}", "2024-01-01T00:00:00.000Z") for i, x in enumerate(ids(e)[:n])]
    return spark.createDataFrame(rows, "archive_id long, pos int, event_id string, kind string, note string, created_at string")


def test_packets_and_handoffs(spark):
    e = events_of(spark, talk("first <b>", "second"), talk("other"))
    p = planning.continuation_packets(archives_of(spark, e), e, notes_of(spark, e))
    got = {r.archive_id: r for r in p.collect()}
    assert got[1].event_ids == ids(e)[0] and "first <b>" in got[1].packet and "second" not in got[1].packet
    assert "other" in got[2].packet and "- none" in got[2].packet
    unknown = spark.createDataFrame([(1, "evt_no", 0)], "archive_id long, event_id string, pos int")
    assert {r.archive_id for r in planning.continuation_packets(archives_of(spark, e), e, notes_of(spark, e, 0), unknown).collect()} == {2}
    assert planning.handoffs(p).first().handoff.startswith("# Handoff")


def test_evaluation(spark):
    e = events_of(spark, talk("old decision", "x" * 30, "y" * 30, "new🔐"))
    chosen = e.filter("sequence = 0")
    r = planning.evaluation_summary(chosen, e, 3).first()
    assert (r.chosen_events, r.chosen_bytes, r.tail_bytes) == (1, 3, 0)
    r = planning.evaluation_summary(chosen, e).first()
    assert (r.chosen_bytes, r.tail_events, r.tail_bytes) == (12, 2, 12)
    h = planning.handoffs(planning.continuation_packets(archives_of(spark, e), e, notes_of(spark, e)))
    kit = planning.evaluations(archives_of(spark, e), chosen, e, h, "decision", "What was decided?", "index").first()
    assert "What was decided?" in kit.instructions and '"bytes":12' in kit.manifest
    with pytest.raises(InputError):
        planning.check_task("\x00")


def test_plans(spark):
    e = events_of(spark, talk("alpha beta", "gamma"), talk("delta " * 400))
    a = archives_of(spark, e)
    plans = {r.archive_id: r for r in planning.prompt_plans(a, e, "ollama", "m1", "semantic", "beta", 1_000).collect()}
    assert len(plans[1].events_included) == 1 and plans[1].input_chars == len(plans[1].prompt)
    assert "[Cut at the approved input limit.]" in plans[2].prompt
    again = {r.archive_id: r.consent_id for r in planning.prompt_plans(a, e, "ollama", "m1", "semantic", "beta", 1_000).collect()}
    other = {r.archive_id: r.consent_id for r in planning.prompt_plans(a, e, "ollama", "m2", "semantic", "beta", 1_000).collect()}
    assert again == {k: v.consent_id for k, v in plans.items()} and again[1] != other[1]
    assert "prompt" not in planning.plan_summaries(planning.prompt_plans(a, e, "ollama", "m1", "summary")).columns
    for bad in (("nobody", "m", "summary"), ("ollama", "-", "summary"), ("ollama", "m", "semantic")):
        with pytest.raises(InputError):
            planning.check_options(*bad, None, 2_000, 100)


def test_plan_violations(spark):
    e = events_of(spark, talk("alpha \"q\" beta", "gamma"))
    p = planning.prompt_plans(archives_of(spark, e), e, "ollama", "m1", "semantic", 'say "beta" \\', 1_000)
    assert planning.plan_violations(p, 1_000, 1_024).count() == 0
    changed = p.withColumn("prompt", F.concat("prompt", F.lit("!"))).withColumn("model", F.lit("-"))
    assert {r.rule for r in planning.plan_violations(changed, 1_000, 1_024).collect()} >= {"model", "input chars", "consent"}
    assert {r.rule for r in planning.plan_violations(p, 999, 1_024).collect()} == {"consent"}


def test_brief_and_viewers(spark):
    e = events_of(spark, talk("<script>alert(1)</script>", "b"))
    a, b = ids(e)
    g = graph.build_graph(e, spark.createDataFrame([(1, a, b, "answers")], "archive_id long, from_id string, to_id string, kind string"))
    text = briefs.brief(archives_of(spark, e), e, notes_of(spark, e), g).first().brief
    assert "- Events: 2" in text and "- Roles: user: 1, assistant: 1" in text and f"- {a} answers {b}" in text and text.count("- none") == 3
    for html in (briefs.viewer(archives_of(spark, e), e, notes_of(spark, e)).first().html, briefs.map_viewer(archives_of(spark, e), e, g).first().html):
        assert "<script>" not in html and "&lt;script&gt;" in html and "default-src 'none'" in html
    long = events_of(spark, talk(*map(str, range(100))))
    assert briefs.map_selection(long, None).count() == 80
    some = spark.createDataFrame([(1, x) for x in [ids(long)[5], ids(long)[3], ids(long)[4], "evt_no"]], "archive_id long, event_id string")
    assert [(r.sequence, r.joined) for r in briefs.map_selection(long, some, 3).orderBy("rank").collect()] == [(3, True), (4, True), (5, False)]


def test_projects(spark):
    members = spark.createDataFrame([("p", 1), ("p", 2)], "project_id string, archive_id long")
    none_a = spark.createDataFrame([], "project_id string, artifact_id string")
    edges = projects.canonical_edges(spark.createDataFrame([("p", "2", "1", "related"), ("p", "1", "9", "supports"), ("p", "1", "1", "odd")], "project_id string, from_id string, to_id string, kind string"))
    claims = spark.createDataFrame([("p", "c1", 1, "e", "decision", "ok"), ("p", "c2", 7, "e", "odd", "")], "project_id string, claim_id string, archive_id long, event_id string, kind string, note string")
    rules = sorted(r.rule for r in projects.project_violations(members, none_a, edges, claims, id_formats=False).collect())
    assert rules == ["claim", "claim of a stranger", "edge kind", "loop", "unknown end"]
    stored = spark.createDataFrame([("p", 1, "h1"), ("p", 2, "h2"), ("p", 3, "h3")], "project_id string, archive_id long, transcript_sha256 string")
    now = spark.createDataFrame([(1, "h1"), (2, "other")], "archive_id long, transcript_sha256 string")
    v = projects.verify_members(stored, now)
    assert {r.archive_id: r.reason for r in v.collect()} == {1: None, 2: "changed", 3: "missing"}
    ev = spark.createDataFrame([(1, "e")], "archive_id long, event_id string")
    c = projects.verify_claims(claims.withColumn("archive_id", F.when(F.col("claim_id") == "c2", 2).otherwise(1).cast("long")), v, ev)
    assert {r.claim_id: r.valid for r in c.collect()} == {"c1": True, "c2": False}
    assert [r.valid for r in projects.project_verdicts(v, c).collect()] == [False]
    assert projects.add_members(members, members).count() == 2


def test_canonical_json():
    assert canonical_json({"b": [1, 2.5, None, True], "a": "\u001f é", "🔐": 1, "～": 2}) == '{"a":"\\u001f é","b":[1,2.5,null,true],"🔐":1,"～":2}'
    assert canonical_json({"x": 1, "y": {"b": 1, "a": 2}}) == canonical_json({"y": {"a": 2, "b": 1}, "x": 1})
    assert [canonical_json(x) for x in (1e21, 1.0, 1e-7, 0.000001, -1.5e-9, 1e300)] == ["1e+21", "1", "1e-7", "0.000001", "-1.5e-9", "1e+300"]
    with pytest.raises(InputError):
        canonical_json(float("nan"))
