"""Files as artifacts, Git heads, and the rules for paths."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_relative_path
from ..model import MAX_FILE_BYTES, InputError

__all__ = ["FILES_AT_ONCE", "artifacts_of", "binary_files", "empty_files", "file_artifacts", "file_key", "file_table", "git_head", "is_relative_path", "repository_artifact"]

#: Files of a folder that is read at once: the driver holds the names of all that one reader reads.
FILES_AT_ONCE = 10_000

HEAD = re.compile(r"[0-9a-f]{40,64}")
FILES = "path string, length long, content binary"
REFERENCE = re.compile(r"ref: (refs/[A-Za-z0-9._/-]+)")


def file_key(path: Column) -> Column:
    """A path by which files are joined: of a local one it is written with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def empty_files(read: DataFrame) -> DataFrame:
    """(path) of the files of a reader that have no bytes, which it lists and leaves out.

    The list of names that is joined is the one that the reader holds anyway.
    """
    listed = read.sparkSession.createDataFrame([(unquote(name),) for name in read.inputFiles()], "path string").select(file_key(F.col("path")).alias("path"))
    return listed.join(read.select(file_key(F.col("path")).alias("path")), "path", "left_anti")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files, those of no bytes too."""
    read = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return read.unionByName(empty_files(read).select("path", F.lit(0).cast("long").alias("length"), F.lit("").cast("binary").alias("content")))


def file_table(spark: SparkSession, paths: Iterable[str], folder: str) -> DataFrame:
    """:func:`binary_files` of many paths, read path by path into one table in ``folder``.

    The driver holds the names below one path at a time, so as many files as
    there are need no more memory there, if they are parted into folders.
    """
    spark.createDataFrame([], FILES).write.parquet(folder)
    for path in paths:
        binary_files(spark, path).write.mode("append").parquet(folder)
    return spark.read.schema(FILES).parquet(folder)


def artifacts_of(files: DataFrame, root: str) -> DataFrame:
    """(path, name, sha256, head) of files (path, length, content), by their paths below ``root``; hashes are taken where files lie."""
    plain = F.regexp_replace("path", f"^(file:)?/*{re.escape(root.strip('/'))}/", "")
    f = files.filter(F.col("length") <= MAX_FILE_BYTES)
    return f.select(plain.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("head"))


def file_artifacts(spark: SparkSession, path: str, root: str) -> DataFrame:
    """:func:`artifacts_of` the files at a path."""
    return artifacts_of(binary_files(spark, path), root)


def git_head(directory: str) -> str:
    """The commit that a repository's HEAD names, from loose files alone."""
    git = Path(directory, ".git")
    if not git.is_dir() or git.is_symlink():
        raise InputError("no .git directory")
    head = git.joinpath("HEAD").read_text("utf-8").strip()
    if HEAD.fullmatch(head):
        return head
    m = REFERENCE.fullmatch(head)
    if not m or ".." in m[1] or not (loose := git / m[1]).is_file():
        raise InputError("HEAD names no loose reference")
    found = loose.read_text("utf-8").strip()
    if not HEAD.fullmatch(found):
        raise InputError("reference is no commit")
    return found


def repository_artifact(spark: SparkSession, directory: str, root: str) -> DataFrame:
    rel = Path(directory).resolve().relative_to(Path(root).resolve()).as_posix()
    return spark.createDataFrame([(rel, Path(rel).name, None, git_head(directory))], "path string, name string, sha256 string, head string")
