"""Portable packages: stored ZIP files of a few named entries.

Files are written by the standard library and read by a strict reader of its
own output's subset: stored entries without flags, extras, comments or gaps,
a directory that repeats them exactly, and a checksum for each.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MAX_PACKAGE_BYTES, InputError

LOCAL, CENTRAL, END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
#: Fixed value: the order of a package's entries; the last two may be missing.
ENTRIES = ("manifest.json", "archive.json", "index.json", "annotations.json", "graph.json")
REQUIRED = 3


def write_stored(files: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of stored entries with fixed dates, so equal files give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files:
            info = zipfile.ZipInfo(name, (1980, 0, 0, 0, 0, 0))
            info.create_system = 0
            z.writestr(info, data)
            info.external_attr = 0  # the directory is written last, and without permissions
    if out.tell() > MAX_PACKAGE_BYTES:
        raise InputError("package too large")
    return out.getvalue()


def read_stored(raw: bytes, allowed: tuple[str, ...] | None = None) -> list[tuple[str, bytes, int]]:
    """(name, data, crc) of a stored ZIP; InputError for anything out of the ordinary.

    With ``allowed`` names, entries must be among them and in that order.
    """

    def need(ok, what):
        if not ok:
            raise InputError(f"package: {what}")

    need(END.size <= len(raw) <= MAX_PACKAGE_BYTES, "size")
    sign, disk, first, count, total, size, start, comment = END.unpack_from(raw, len(raw) - END.size)
    need(sign == b"PK\x05\x06" and (disk, first, comment) == (0, 0, 0) and count == total, "end record")
    stop = len(raw) - END.size
    need(start + size == stop, "directory place")
    local, at = [], 0
    while at < start:
        need(at + LOCAL.size <= start, "local header")
        sign, version, flags, method, time, date, crc, packed, plain, n, extra = LOCAL.unpack_from(raw, at)
        need(sign == b"PK\x03\x04" and (version, flags, method, time, date, extra) == (20, 0, 0, 0, 0, 0) and packed == plain, "local feature")
        body = at + LOCAL.size + n
        need(body + plain <= start, "local size")
        try:
            name = raw[at + LOCAL.size : body].decode("ascii")
        except UnicodeDecodeError as e:
            raise InputError("package: name") from e
        data = raw[body : body + plain]
        need(zlib.crc32(data) == crc, "checksum")
        local.append((name, data, crc, at))
        at = body + plain
    need(len(local) == count and len({x[0] for x in local}) == count, "entry count")
    listed = []
    while at < stop:
        need(at + CENTRAL.size <= stop, "directory header")
        sign, made, version, flags, method, time, date, crc, packed, plain, n, extra, note, disk, inner, outer, place = CENTRAL.unpack_from(raw, at)
        need(sign == b"PK\x01\x02" and (made, version, flags, method, time, date, extra, note, disk, inner, outer) == (20, 20, 0, 0, 0, 0, 0, 0, 0, 0, 0) and packed == plain, "directory feature")
        name = raw[at + CENTRAL.size : at + CENTRAL.size + n].decode("ascii", "replace")
        listed.append((name, crc, plain, place))
        at += CENTRAL.size + n
    need(at == stop and listed == [(n, c, len(d), p) for n, d, c, p in local], "directory differs")
    names = [x[0] for x in local]
    if allowed is not None:
        need(names == [n for n in allowed if n in names] and set(allowed[:REQUIRED]) <= set(names), "entries")
    return [(n, d, c) for n, d, c, _ in local]


def pack_archives(files: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """(archive_id, content) from (archive_id, name, data): one package for each archive.

    Entries named in ``order`` come first and in that order, others by name.

    An archive's files are bounded by the package limit and meet in one group.
    """

    def pack(key, table):
        rank = {name: i for i, name in enumerate(order)}
        rows = sorted(zip(table.column("name").to_pylist(), table.column("data").to_pylist()), key=lambda r: (rank.get(r[0], len(rank)), r[0]))
        return pa.table({"archive_id": [key[0].as_py()], "content": pa.array([write_stored(rows)], pa.binary())})

    kind = files.schema["archive_id"].dataType.simpleString()
    return files.groupBy("archive_id").applyInArrow(pack, f"archive_id {kind}, content binary")


def read_packages(packages: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """(archive_id, name, data, crc) of each entry of (archive_id, content); a bad package is an error."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("archive_id"), []
            for i, raw in enumerate(batch.column("content").to_pylist()):
                rows += [(i, *e) for e in read_stored(raw, allowed)]
            if rows:
                which, names, data, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int32())), pa.array(names), pa.array(data, pa.binary()), pa.array(crc, pa.int64())], names=["archive_id", "name", "data", "crc"])

    kind = packages.schema["archive_id"].dataType.simpleString()
    return packages.select("archive_id", "content").mapInArrow(run, f"archive_id {kind}, name string, data binary, crc long")


def load_packages(spark: SparkSession, path: str) -> DataFrame:
    """(archive_id, content) of package files; the identifier comes from the path."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MAX_PACKAGE_BYTES)
    return files.select(F.xxhash64("path").alias("archive_id"), "content")


def manifests(files: DataFrame) -> DataFrame:
    """(archive_id, manifest): paths, lengths and hashes of an archive's files in name order, as JSON."""
    entry = F.struct(F.col("name").alias("path"), F.octet_length("data").alias("byteLength"), F.sha2("data", 256).alias("sha256"))
    return files.groupBy("archive_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(entry)).alias("files"))).alias("manifest"))


def manifest_violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(archive_id, rule, subject) where entries and manifest differ; ``manifest`` has archive_id, path, byteLength and sha256."""
    have = files.filter("name <> 'manifest.json'").select("archive_id", F.col("name").alias("path"), F.octet_length("data").alias("_n"), F.sha2("data", 256).alias("_sha"))
    j = have.join(manifest, ["archive_id", "path"], "full")
    rule = F.when(F.col("_n").isNull(), "listed only").when(F.col("sha256").isNull(), "not listed").when((F.col("_n") != F.col("byteLength")) | (F.col("_sha") != F.col("sha256")), "differs")
    return j.select("archive_id", rule.alias("rule"), F.col("path").alias("subject")).filter("rule is not null")
