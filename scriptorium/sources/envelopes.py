"""Encrypted archives: scrypt keys and AES-256-GCM, as JSON envelopes.

Keys are derived in Arrow functions, one for each salt; the bytes are encrypted
by Spark's function.  A derivation is dear on purpose, so a salt serves several
rows of one call, which one passphrase opens anyway; nonces are each row's own.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MAX_SECRET_BYTES, InputError

# The only key derivation that is read or written.
N, R, P, KEY, SALT, NONCE, TAG = 16_384, 8, 1, 32, 16, 12, 16
#: Rows that a salt and its key serve at most; random nonces of one key would allow billions.
ROWS_PER_SALT = 256
#: Keys that a task remembers.
KEYS = 4_096
SCHEMA = "envelope/1"
ENVELOPE = "struct<schema:string,kdf:struct<name:string,N:int,r:int,p:int,salt:string>,cipher:struct<name:string,nonce:string,tag:string>,ciphertext:string>"


def _check(passphrase: bytes) -> bytes:
    if not 12 <= len(passphrase) <= 1_024:
        raise InputError("a passphrase has 12 to 1,024 bytes")
    return passphrase


def _key(passphrase: bytes, salt: bytes) -> bytes:
    return hashlib.scrypt(passphrase, salt=salt, n=N, r=R, p=P, dklen=KEY, maxmem=64 << 20)


def encrypt(archives: DataFrame, passphrase: bytes, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(archive_id, envelope) of (archive_id, content); content is bytes, not empty and within the limit.

    Salt, nonce and key come from one function, so a row's are of one piece;
    a row that is computed again gets others.  Up to ``rows_per_salt`` rows of
    a task have one salt; with 1 each row has its own.
    """
    _check(passphrase)

    def fresh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        left = 0
        for ids in batches:
            rows = []
            for _ in range(len(ids)):
                if not left:
                    salt, left = os.urandom(SALT), rows_per_salt
                    key = _key(passphrase, salt)
                left -= 1
                rows.append({"salt": salt, "nonce": os.urandom(NONCE), "key": key})
            yield pa.array(rows, pa.struct([("salt", pa.binary()), ("nonce", pa.binary()), ("key", pa.binary())]))

    make = F.arrow_udf(fresh, T.StructType([T.StructField(c, T.BinaryType()) for c in ("salt", "nonce", "key")])).asNondeterministic()
    size = F.octet_length("content")
    content = F.when(size.between(1, MAX_SECRET_BYTES), F.col("content")).otherwise(F.raise_error(F.lit("content is empty or too large")))
    k = archives.withColumn("k", make(F.col("archive_id").cast("string"))).select("archive_id", "k.*", content.alias("content"))
    k = k.withColumn("raw", F.aes_encrypt("content", "key", F.lit("GCM"), F.lit("DEFAULT"), F.col("nonce")))
    n = F.octet_length("raw")
    part = lambda start, length: F.base64(F.substring(F.col("raw"), start, length))
    doc = F.struct(
        F.lit(SCHEMA).alias("schema"), F.struct(F.lit("scrypt").alias("name"), F.lit(N).alias("N"), F.lit(R).alias("r"), F.lit(P).alias("p"), F.base64("salt").alias("salt")).alias("kdf"),
        F.struct(F.lit("aes-256-gcm").alias("name"), F.base64("nonce").alias("nonce"), part(n - TAG + 1, F.lit(TAG)).alias("tag")).alias("cipher"), part(F.lit(NONCE + 1), n - NONCE - TAG).alias("ciphertext"),
    )
    return k.select("archive_id", F.to_json(doc).alias("envelope"))


def decrypt(envelopes: DataFrame, passphrase: bytes) -> DataFrame:
    """(archive_id, content, error) of (archive_id, envelope); a wrong passphrase and altered bytes look the same."""
    _check(passphrase)

    def derive(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys: dict[bytes | None, bytes | None] = {None: None}
        for salts in batches:
            out = []
            for salt in salts.to_pylist():
                if salt not in keys:
                    if len(keys) > KEYS:
                        keys = {None: None}
                    keys[salt] = _key(passphrase, salt)
                out.append(keys[salt])
            yield pa.array(out, pa.binary())

    key = F.arrow_udf(derive, T.BinaryType())
    e = envelopes.select("archive_id", F.from_json("envelope", ENVELOPE).alias("e"))
    raw = lambda c: F.try_to_binary(F.col(c), F.lit("base64"))
    e = e.select("archive_id", "e", raw("e.kdf.salt").alias("salt"), raw("e.cipher.nonce").alias("nonce"), raw("e.cipher.tag").alias("tag"), raw("e.ciphertext").alias("text"))
    known = (F.col("e.schema") == SCHEMA) & (F.col("e.kdf.name") == "scrypt") & (F.col("e.kdf.N") == N) & (F.col("e.kdf.r") == R) & (F.col("e.kdf.p") == P) & (F.col("e.cipher.name") == "aes-256-gcm")
    sized = (F.octet_length("salt") == SALT) & (F.octet_length("nonce") == NONCE) & (F.octet_length("tag") == TAG) & F.octet_length("text").between(1, MAX_SECRET_BYTES)
    e = e.withColumn("ok", F.coalesce(known & sized, F.lit(False))).withColumn("key", key(F.when(F.col("ok"), F.col("salt"))))
    plain = F.when(F.col("ok"), F.try_aes_decrypt(F.concat("nonce", "text", "tag"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT")))
    out = e.select("archive_id", "ok", plain.alias("content"))
    return out.select("archive_id", "content", F.when(~F.col("ok"), "unsupported envelope").when(F.col("content").isNull(), "wrong passphrase or altered").alias("error"))
