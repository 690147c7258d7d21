"""URL filter by a tree of path templates, in DataFrame functions only.

Paths of a host form a tree of segments.  Digits and long hexadecimal runs are
typed wildcards from the start.  Then, level by level from the root, a segment
becomes ``*`` where its position is variable (many different children, none of
them frequent), and sibling branches that have labels are merged into one
``*`` branch where their labelled rate does not differ from that of their
siblings by a two-proportion test and their commonest child is the same.
A template's labelled purity, the share of block labels, is smoothed towards
the purity of its shapes over all hosts and that towards the overall rate.
Templates of a purity over the threshold are rejected.

Pages are aggregated to (host, shape) before the tree is made, so what is
shuffled for it are shapes; only pages that no rule decides join the templates.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

NO_SEGMENT = ""

#: (action, host, path): fixed values of the query's contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", 1)), F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (its text) and its action, or nulls.

    A rule fits its host and subdomains if the path starts with the rule's.
    Equal lengths fall to the smaller text.
    """
    name = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, action)


def shape_of(path: Column) -> Column:
    """The lexical shape of a path: no slash at either end, long hexadecimal runs and numbers as typed wildcards."""
    p = F.regexp_replace(path, "^/|/$", "")
    p = F.regexp_replace(p, "[0-9A-Fa-f]{16,}", "{x}")
    return F.regexp_replace(p, "[0-9]+", "{n}")


def path_templates(shapes: DataFrame, max_children: int = 16, min_share: float = 0.05, min_labels: int = 20, z_max: float = 1.96) -> DataFrame:
    """``shapes`` (host, shape, n, block, allow) with each one's ``template``.

    Level by level from the root, as deep as two shapes share a way.  A shape
    that is alone below a node has no siblings to merge with there or further
    down, so it is done, however deep its path is.
    """
    live = cut(shapes.select("*", F.split("shape", "/").alias("_parts"), F.lit("").alias("_way")))
    done, level = [], 0
    while True:
        level += 1
        t = live.withColumn("_seg", F.element_at("_parts", level)).withColumn("_next", F.coalesce(F.try_element_at("_parts", F.lit(level + 1)), F.lit(NO_SEGMENT)))
        # per branch: counts and its commonest child
        kinds = t.groupBy("host", "_way", "_seg", "_next").agg(F.sum("n").alias("n"), F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("rows"))
        branch = kinds.groupBy("host", "_way", "_seg").agg(F.sum("n").alias("_n"), F.sum("block").alias("_b"), F.sum("allow").alias("_a"), F.sum("rows").alias("_r"), F.max(F.struct("n", F.col("_next").alias("c")))["c"].alias("_commonest"))
        stats = branch.groupBy("host", "_way").agg(
            F.count("*").alias("_children"), F.sum("_n").alias("_total"), F.sum("_b").alias("_pb"), F.sum("_a").alias("_pa"), F.sum("_r").alias("_rows"),
            F.max(F.struct(F.col("_n").alias("n"), F.col("_commonest").alias("c")))["c"].alias("_common"),
        ).withColumnsRenamed({"host": "_h", "_way": "_w"})
        b = branch.join(stats, (F.col("host") == F.col("_h")) & (F.col("_way") == F.col("_w"))).drop("_h", "_w")
        own, rest = F.col("_b") + F.col("_a"), F.col("_pb") + F.col("_pa") - F.col("_b") - F.col("_a")
        r1, r2 = (F.col("_b") + 1.0) / (own + 2.0), (F.col("_pb") - F.col("_b") + 1.0) / (rest + 2.0)
        pooled = (F.col("_pb") + 1.0) / (own + rest + 2.0)
        z2 = (r1 - r2) * (r1 - r2) / (pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / (own + 2.0) + F.lit(1.0) / (rest + 2.0)))
        variable = (F.col("_children") > max_children) & (F.col("_n") < F.col("_total") * min_share)
        similar = (own >= min_labels) & (rest >= min_labels) & (F.col("_commonest") == F.col("_common")) & (z2 < z_max * z_max)
        named = F.when((F.col("_seg") != NO_SEGMENT) & (variable | similar), F.lit("*")).otherwise(F.col("_seg"))
        b = b.select(F.col("host").alias("_h"), F.col("_way").alias("_w"), F.col("_seg").alias("_s"), named.alias("_name"), (F.col("_rows") == 1).alias("_alone"))
        t = t.join(b, (F.col("host") == F.col("_h")) & (F.col("_way") == F.col("_w")) & (F.col("_seg") == F.col("_s")))
        below = F.array_join(F.slice("_parts", level, F.greatest(F.size("_parts"), F.lit(1))), "/")
        t = t.withColumn("_way", F.concat("_way", F.lit("/"), F.when(F.col("_alone"), below).otherwise(F.col("_name"))))
        t = t.withColumn("_ended", F.col("_alone") | (F.size("_parts") <= level))
        # each level reads the one before it three times: written down, the plan stays small
        t = cut(t.select(*shapes.columns, "_parts", "_way", "_ended"))
        done.append(t.filter("_ended").select(*shapes.columns, F.col("_way").alias("template")))
        live = t.filter("not _ended").drop("_ended")
        if live.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)


def template_verdicts(shapes: DataFrame, threshold: float = 0.6, prior_weight: float = 10.0, **tree) -> DataFrame:
    """(host, shape) with ``template``, ``purity`` and the method's ``verdict``."""
    over_hosts = shapes.groupBy("shape").agg(F.sum("block").alias("_b"), F.sum("allow").alias("_a"))
    over_hosts = over_hosts.select(F.col("shape").alias("_s"), ((F.col("_b") + F.lit(prior_weight * 0.5)) / (F.col("_b") + F.col("_a") + prior_weight)).alias("_prior"))
    rows = cut(path_templates(shapes, **tree).join(over_hosts, F.col("shape") == F.col("_s")).drop("_s"))
    per_template = rows.groupBy("host", "template").agg(F.sum("block").alias("_b"), F.sum("allow").alias("_a"), F.sum(F.round(F.col("_prior") * F.col("n"), 9).cast("decimal(38,9)")).cast("double").alias("_w"), F.sum("n").alias("_n"))
    purity = (F.col("_b") + F.lit(prior_weight) * (F.col("_w") / F.col("_n"))) / (F.col("_b") + F.col("_a") + prior_weight)
    per_template = per_template.select(F.col("host").alias("_host"), F.col("template").alias("_t"), purity.alias("purity"))
    out = rows.join(per_template, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_t")))
    return out.select("host", "shape", "template", "purity", F.when(F.col("purity") > threshold, "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.6, **tree) -> DataFrame:
    """Identifier, host, path, rule, template, verdict for each row of ``pages``.

    Pages that a rule decides keep its action and are the labels; the others
    get their template's.  A null url, one without ``://`` and one without a
    host are judged like any other, by the template of the empty host and path.
    Repeated rows are judged each.  An empty table gives an empty result.
    ``template`` is null where a rule decides.
    """
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select(id_col, "host", "path", rule.alias("rule"), action.alias("_action"), shape_of(F.col("path")).alias("shape"))
    shapes = cut(p.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("_action") == "block").alias("block"), F.count_if(F.col("_action") == "allow").alias("allow")))
    verdicts = template_verdicts(shapes, threshold, **tree)
    verdicts = verdicts.select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), "template", "verdict")
    ruled = p.filter(F.col("rule").isNotNull()).select(id_col, "host", "path", "rule", F.lit(None).cast("string").alias("template"), F.col("_action").alias("verdict"))
    open_ = p.filter(F.col("rule").isNull()).join(verdicts, (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")), "left")
    return ruled.unionByName(open_.select(id_col, "host", "path", "rule", "template", "verdict"))
