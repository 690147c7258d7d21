"""Ordered batches of changes to projects and annotations.

A batch is a table of operations with their order.  Each operation sees what
those before it have changed, so a batch gives what its operations would give
one after the other; an operation that breaks a rule is refused with the rule
and changes nothing.  The tables are joined and ranked as wholes: an operation
is the first of its key, or within a cap, by a running count of those before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_relative_path, is_text
from ..model import ANNOTATION_KINDS, MAX_ANNOTATIONS, MAX_NOTE_UNITS
from .integrity import HASH, union_all
from .projects import CLAIM_KINDS, EDGE_KINDS, GIT_HEAD, MAX_ARTIFACT_NAME, MAX_LINKS, MAX_MEMBERS, MAX_NAME, canonical_edges

#: The columns of a batch; each operation reads some of them.
BATCH = "seq long, op string, project_id string, id string, archive_id long, event_id string, from_id string, to_id string, kind string, name string, note string, path string, sha256 string, head string, created_at string"
#: Operations, the tables that they add to, and what is unique in those.
TABLES = {
    "project": ("projects", ["project_id"]), "member": ("members", ["project_id", "archive_id"]), "artifact": ("artifacts", ["project_id", "artifact_id"]),
    "edge": ("edges", ["project_id", "from_id", "to_id", "kind"]), "claim": ("claims", ["project_id", "claim_id"]), "annotation": ("annotations", None),
}


@dataclass(frozen=True)
class Caps:
    members: int = MAX_MEMBERS
    artifacts: int = MAX_MEMBERS
    edges: int = MAX_LINKS
    claims: int = MAX_LINKS
    annotations: int = MAX_ANNOTATIONS


def _first_rule(rules: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()])


def _decided(rows: DataFrame, rules: dict[str, Column], stored: DataFrame, keys: list[str] | None, of: str | None, cap: int) -> DataFrame:
    """``rows`` with ``rule``, null where the operation is applied, and ``place``, its number among those of ``of``."""
    rows = rows.withColumn("rule", _first_rule(rules)).withColumn("_new", F.col("rule").isNull())
    before = Window.partitionBy(*(keys or [])).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    if keys:
        rows = rows.join(stored.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left").withColumn("_there", F.col("_there").isNotNull())
        rows = rows.withColumn("_new", F.col("_new") & ~F.col("_there") & (F.count_if("_new").over(before) == 0))
    if of:
        rows = rows.join(stored.groupBy(of).agg(F.count("*").alias("_have")), of, "left")
        upto = Window.partitionBy(of).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("place", F.count_if("_new").over(upto) + F.coalesce("_have", F.lit(0)) - 1).drop("_have")
        rows = rows.withColumn("_new", F.col("_new") & (F.col("place") < cap))
    if keys:
        # of equal keys the first is applied, unless it is over the cap as those after it are
        again = F.col("_there") | (F.count_if("_new").over(before) > 0)
        rows = rows.withColumn("rule", F.coalesce("rule", F.when(again, F.lit("repeated")))).drop("_there")
    return rows.withColumn("rule", F.coalesce("rule", F.when(~F.col("_new"), F.lit("too many")))).drop("_new")


def _since(stored: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """When a key is there: -1 for what is stored, else the order of the operation that added it."""
    return stored.select(*keys, F.lit(-1).cast("long").alias("since")).unionByName(decided.filter("rule is null").select(*keys, F.col("seq").alias("since")))


def _known(rows: DataFrame, there: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether the key was there before the operation."""
    t = there.groupBy(*keys).agg(F.min("since").alias("_since"))
    return rows.join(t, keys, "left").withColumn(flag, F.coalesce(F.col("_since") < F.col("seq"), F.lit(False))).drop("_since")


def apply_batch(state: dict[str, DataFrame], batch: DataFrame, caps: Caps = Caps()) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows to add by table, verdicts) of a batch on the tables archives, events, projects, members, artifacts, edges, claims and annotations.

    Verdicts are (seq, op, rule), a null rule for what is applied.  Operations
    without an order, of the same order as another, or of an unknown name are
    refused.  Members keep the transcript's hash as it is; a claim needs one
    that has not changed.
    """
    of = Window.partitionBy("seq")
    named = batch.withColumn("_same", F.count("*").over(of))
    order = F.when(F.col("seq").isNull() | (F.col("_same") > 1), "order").when(~F.coalesce(F.col("op").isin(*TABLES), F.lit(False)), "operation")
    named = named.withColumn("rule", order).drop("_same")
    sound = named.filter("rule is null").drop("rule")
    op = lambda name: sound.filter(F.col("op") == name)
    one = lambda c, *values: F.col(c).isin(*values)
    date = lambda c: F.try_to_timestamp(c).isNull()

    projects = _decided(op("project"), {"project": F.col("project_id").isNull(), "name": ~is_text(F.col("name"), MAX_NAME), "created_at": date("created_at")}, state["projects"], ["project_id"], None, 0)
    there = _since(state["projects"], projects, ["project_id"])
    project = {"unknown project": ~F.col("_project")}

    archives = state["archives"].select("archive_id", "transcript_sha256")
    members = _known(op("member"), there, ["project_id"], "_project").join(archives, "archive_id", "left")
    members = _decided(members, project | {"unknown archive": F.col("transcript_sha256").isNull()}, state["members"], ["project_id", "archive_id"], "project_id", caps.members)

    artifacts = _known(op("artifact").withColumn("artifact_id", F.col("id")), there, ["project_id"], "_project")
    hashed = F.col("sha256").rlike(HASH) & F.col("head").isNull() | F.col("head").rlike(GIT_HEAD) & F.col("sha256").isNull()
    rules = project | {"artifact": F.col("id").isNull(), "path": ~is_relative_path(F.col("path")), "name": ~is_text(F.col("name"), MAX_ARTIFACT_NAME), "hash": ~F.coalesce(hashed, F.lit(False))}
    artifacts = _decided(artifacts, rules, state["artifacts"], ["project_id", "artifact_id"], "project_id", caps.artifacts)

    node = lambda df, c: df.withColumn("node", F.col(c).cast("string"))
    nodes = _since(node(state["members"], "archive_id"), node(members, "archive_id"), ["project_id", "node"]).unionByName(_since(node(state["artifacts"], "artifact_id"), node(artifacts, "artifact_id"), ["project_id", "node"]))
    edges = canonical_edges(op("edge"))
    for end in ("from_id", "to_id"):
        edges = _known(edges, nodes.withColumnRenamed("node", end), ["project_id", end], f"_{end}")
    rules = {"edge kind": ~one("kind", *EDGE_KINDS), "unknown end": ~(F.col("_from_id") & F.col("_to_id")), "loop": F.col("from_id") == F.col("to_id")}
    edges = _decided(edges, rules, state["edges"], TABLES["edge"][1], "project_id", caps.edges)

    unchanged = state["members"].join(archives.withColumnRenamed("transcript_sha256", "_now"), "archive_id").filter(F.col("transcript_sha256").eqNullSafe(F.col("_now")))
    events = state["events"].select("archive_id", "event_id").distinct().withColumn("_event", F.lit(True))
    claims = _known(op("claim").withColumn("claim_id", F.col("id")), _since(unchanged, members, ["project_id", "archive_id"]), ["project_id", "archive_id"], "_member").join(events, ["archive_id", "event_id"], "left")
    rules = {"claim": F.col("id").isNull(), "archive not valid": ~F.col("_member"), "unknown event": F.col("_event").isNull(), "kind": ~one("kind", *CLAIM_KINDS), "note": ~is_text(F.col("note"), MAX_NOTE_UNITS)}
    claims = _decided(claims, rules, state["claims"], ["project_id", "claim_id"], "project_id", caps.claims)

    notes = op("annotation").join(events, ["archive_id", "event_id"], "left")
    short = F.char_length("note").between(1, MAX_NOTE_UNITS)
    rules = {"unknown event": F.col("_event").isNull(), "kind": ~one("kind", *ANNOTATION_KINDS), "note": ~F.coalesce(short, F.lit(False)), "created_at": date("created_at")}
    last = state["annotations"].groupBy("archive_id").agg(F.max("pos").alias("_last"), F.count("*").alias("_n"))
    notes = _decided(notes, rules, state["annotations"], None, "archive_id", caps.annotations).join(last, "archive_id", "left")
    # after the last position, which may be past the count
    notes = notes.withColumn("pos", (F.col("place") + F.coalesce(F.col("_last") + 1 - F.col("_n"), F.lit(0))).cast("int"))

    decided = {"projects": projects, "members": members, "artifacts": artifacts, "edges": edges, "claims": claims, "annotations": notes}
    added = {name: df.filter("rule is null").select([c for c in state[name].columns if c in df.columns]) for name, df in decided.items()}
    verdicts = union_all([named.filter("rule is not null").select("seq", "op", "rule"), *[df.select("seq", "op", "rule") for df in decided.values()]])
    return added, verdicts
