"""Closed shapes of JSON documents, checked at every depth.

A shape is ``"string"``, ``"integer"``, ``"number"`` or ``"boolean"``, a list
of one shape for arrays, or a dictionary of keys for objects; a key that ends
in ``?`` may be absent.  Documents are walked as variants, one level of all
documents at a time, so nothing is lost to a schema that does not know a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Shape = str | list | dict

#: How the type of a variant begins, by the name that shapes have for it.
_KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "null": "VOID"}


def _kind(shape: Shape) -> str:
    return "object" if isinstance(shape, dict) else "array" if isinstance(shape, list) else shape


def _inside(nodes: dict[str, Shape]) -> dict[str, Shape]:
    """The shapes one level below, by their place."""
    out = {}
    for at, shape in nodes.items():
        if isinstance(shape, dict):
            out |= {f"{at}.{key.removesuffix('?')}": s for key, s in shape.items()}
        elif isinstance(shape, list):
            out[f"{at}[]"] = shape[0]
    return out


def _is(kind: Column, expected: str) -> Column:
    return kind.isin("integer", "number") if expected == "number" else kind == expected


def _broken(nodes: dict[str, Shape]) -> Column:
    """The (rule, subject) pairs of a value: another type, or keys that are not there."""
    rules = []
    for at, shape in nodes.items():
        here, right = F.col("at") == at, _is(F.col("kind"), _kind(shape))
        rules.append(F.when(here & ~right, F.struct(F.lit("wrong type").alias("rule"), F.concat(F.col("path"), F.lit(f" is no {_kind(shape)}")).alias("subject"))))
        needed = [k for k in shape if not k.endswith("?")] if isinstance(shape, dict) else []
        rules += [F.when(here & right & F.try_variant_get("v", f"$.{k}", "variant").isNull(), F.struct(F.lit("missing field").alias("rule"), F.concat(F.col("path"), F.lit(f".{k}")).alias("subject"))) for k in needed]
    return F.array_compact(F.array(*rules))


def shape_violations(texts: DataFrame, shape: Shape, column: str = "raw") -> DataFrame:
    """(archive_id, rule, subject) for texts (archive_id, raw) that are no JSON or not of the shape.

    Subjects are paths, as ``$.events[3].more``.  A text with a key twice is
    no JSON here, for readers take different ones of the two.  What lies below
    an unknown key or a value of another type is not looked at.
    """
    spark = texts.sparkSession
    level = texts.select("archive_id", F.lit("$").alias("at"), F.lit("$").alias("path"), F.try_parse_json(column).alias("v"))
    parts = [level.filter("v is null").select("archive_id", F.lit("not JSON").alias("rule"), F.lit("$").alias("subject"))]
    level, nodes = level.filter("v is not null"), {"$": shape}
    while nodes:
        said = F.schema_of_variant("v")
        level = level.withColumn("kind", reduce(lambda c, k: c.when(said.startswith(k[1]), F.lit(k[0])), _KINDS.items(), F.when(F.lit(False), "")).otherwise("number"))
        parts.append(level.select("archive_id", F.explode(_broken(nodes)).alias("b")).select("archive_id", "b.rule", "b.subject"))
        below = _inside(nodes)
        if not below:
            break
        full = reduce(Column.__or__, [(F.col("at") == at) & (F.col("kind") == _kind(s)) for at, s in nodes.items() if not isinstance(s, str)])
        entries = level.filter(full).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        keyed = F.col("kind") == "object"
        entries = entries.select(
            "archive_id", F.concat("at", F.when(keyed, F.concat(F.lit("."), "key")).otherwise(F.lit("[]"))).alias("at"),
            F.concat("path", F.when(keyed, F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))).alias("path"), F.col("value").alias("v"),
        )
        known = F.col("at").isin(*below)
        parts.append(entries.filter(~known).select("archive_id", F.lit("unknown field").alias("rule"), F.col("path").alias("subject")))
        level, nodes = entries.filter(known), below
    return reduce(DataFrame.unionByName, parts)
