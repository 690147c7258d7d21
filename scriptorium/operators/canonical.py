"""Canonical JSON: keys sorted by UTF-16 code units, no white space, as JavaScript writes values."""

from __future__ import annotations

import json
import math
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import InputError


def _number(x) -> str:
    if isinstance(x, int):
        return str(x) if abs(x) < 10**21 else _number(float(x))
    if not math.isfinite(x):
        raise InputError("number is not finite")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = repr(x).partition("e")
    if not power:
        return digits
    if -7 < (e := int(power)) < 0:  # JavaScript writes down to 1e-6 without an exponent
        sign, body = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        return f"{sign}0.{'0' * (-e - 1)}{body.replace('.', '')}"
    return f"{digits.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical_json(value) -> str:
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"


@F.arrow_udf(T.StringType())
def canonical_sha256(raw: pa.Array) -> pa.Array:
    """The hash of each JSON text's canonical form, null for what is not JSON."""

    def one(text):
        try:
            return None if text is None else sha256(canonical_json(json.loads(text)).encode("utf-8", "surrogatepass")).hexdigest()
        except (ValueError, InputError):
            return None

    return pa.array([one(t) for t in raw.to_pylist()], pa.string())
