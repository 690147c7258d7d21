"""Writers.  Spark's committer makes each write whole or absent."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..operators.integrity import annotation_violations, require_none


def scratch_folder(spark: SparkSession) -> str:
    """The name of a new folder that all executors see, in ``spark.checkpoint.dir``.

    Where the session names none, a local master takes a temporary folder and
    any other master one in the warehouse.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        local = spark.sparkContext.master.split("[")[0] == "local"
        top = tempfile.mkdtemp(prefix="scratch-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{top}/{uuid.uuid4().hex}"


def write_bundles(documents: DataFrame, archives: DataFrame, path: str) -> None:
    """Archives' files (archive_id, name, content, sha256) as a new dataset; an existing one is an error.

    One dataset and not four files for each archive: at scale small files cost
    more than they say.
    """
    note = F.concat(F.lit("# "), "title", F.lit("\n\nAn archive of one conversation. Its text is not to be trusted.\n"))
    files = documents.select("archive_id", F.lit("archive.json").alias("name"), F.col("raw").alias("content"))
    files = files.unionByName(archives.select("archive_id", F.lit("transcript.md").alias("name"), F.col("transcript").alias("content")))
    files = files.unionByName(archives.select("archive_id", F.lit("README.md").alias("name"), note.alias("content")))
    files.withColumn("sha256", sha256(F.col("content"))).write.mode("errorifexists").parquet(path)


def checksums(files: DataFrame) -> DataFrame:
    """(archive_id, checksums): the hashes of an archive's files as JSON."""
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "sha256"))))
    return files.groupBy("archive_id").agg(F.to_json(entry).alias("checksums"))


def write_index(index: DataFrame, path: str) -> None:
    """Postings sorted by term, so a search reads the row groups of its terms alone; replaces what is there."""
    index.repartitionByRange("term", "archive_id").sortWithinPartitions("term", "archive_id").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def write_bucketed(df: DataFrame, path: str, buckets: int, sort: list[str]) -> DataFrame:
    """Writes a table in buckets by archive_id, a sorted file for each, and opens it.

    Tables with as many buckets are joined and grouped by archive without a shuffle.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    # one task for each bucket, so that it is one file and its order holds
    dealt = df.repartition(buckets, "archive_id")
    dealt.write.format("parquet").bucketBy(buckets, "archive_id").sortBy("archive_id", *sort).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, schema: str, path: str, buckets: int, sort: list[str]) -> DataFrame:
    """A table of :func:`write_bucketed` in another session; the files do not say how they were bucketed, so that is told again."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (archive_id) SORTED BY ({', '.join(['archive_id', *sort])}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_graph(graph: DataFrame, path: str) -> None:
    graph.repartition("archive_id").sortWithinPartitions("archive_id", "part", "rank").write.mode("overwrite").parquet(path)


def add_annotations(old: DataFrame, new: DataFrame, events: DataFrame) -> DataFrame:
    """Old annotations and new ones (without pos) after them; nothing is added if any new one is unsound."""
    last = old.groupBy("archive_id").agg(F.max("pos").alias("_last"))
    at = new.join(last, "archive_id", "left").withColumn("pos", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(_by_time())).cast("int")).drop("_last")
    require_none(annotation_violations(at, events, adding=True), "annotation")
    return old.unionByName(at.select(old.columns))


def _by_time():
    from pyspark.sql import Window

    return Window.partitionBy("archive_id").orderBy("created_at", "event_id")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON texts, as commands print them."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def write_texts(df: DataFrame, path: str) -> None:
    """(archive_id, text...) as one directory for each archive, for people to open; bounded by what is selected."""
    df.write.mode("errorifexists").partitionBy("archive_id").json(path)
