"""Codecs: log sequence names, cursors, index keys, canonical JSON, digests."""

from __future__ import annotations

import json
import math
import os
import re
import struct
import time
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foldlake.errors import EngineError
from foldlake.predicate import kind_of

# The alphabet and the widths of the parts of a log sequence name.
ALPHABET = "0123456789abcdefghijklmnopqrstuv"
SEQ_WIDTH, SEQ_MAX = 11, 2**53 - 1
TIME_WIDTH, TIME_MAX = 9, 2**42 - 1
LSN = re.compile(r"^([0-9a-v]{9})_([0-9a-v]{6})_([0-9a-v]{11})$")


def base32(n: int, width: int) -> str:
    out = ""
    for _ in range(width):
        out = ALPHABET[n & 31] + out
        n >>= 5
    return out


def unbase32(s: str) -> int:
    return int(s, 32)


def lsn(ms: int, session: str, seq: int) -> str:
    """Name of a log entry; plain string order is newest first."""
    if not 0 <= seq <= SEQ_MAX or not 0 <= ms <= TIME_MAX:
        raise EngineError("InvalidConfig", "time or sequence number out of range")
    return f"{base32(TIME_MAX - ms, TIME_WIDTH)}_{session}_{base32(SEQ_MAX - seq, SEQ_WIDTH)}"


def parse_lsn(s: str) -> tuple[int, str, int]:
    m = LSN.match(s)
    if not m:
        raise EngineError("SchemaError", f"malformed log sequence name {s!r}")
    return TIME_MAX - unbase32(m[1]), m[2], SEQ_MAX - unbase32(m[3])


def base32_col(n: Column, width: int) -> Column:
    return F.lower(F.lpad(F.conv(n.cast("string"), 10, 32), width, "0"))


def descending_col(n: Column, top: int, width: int) -> Column:
    return base32_col(F.lit(top) - n, width)


def lsn_col(ms: Column, session: Column, seq: Column) -> Column:
    return F.concat_ws("_", descending_col(ms, TIME_MAX, TIME_WIDTH), session, descending_col(seq, SEQ_MAX, SEQ_WIDTH))


def lsn_seq_col(name: Column) -> Column:
    """The sequence number of a name; null if it is malformed."""
    digits = F.conv(F.upper(F.split_part(name, F.lit("_"), F.lit(3))), 32, 10).cast("bigint")
    return F.when(name.rlike(LSN.pattern), F.lit(SEQ_MAX) - digits)


def uuid7() -> str:
    ms, rand = int(time.time() * 1000), int.from_bytes(os.urandom(10), "big")
    n = (ms & (2**48 - 1)) << 80 | 7 << 76 | (rand >> 68 & 0xFFF) << 64 | 2 << 62 | rand & (2**62 - 1)
    h = f"{n:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def uuid7_col() -> Column:
    """Time-ordered random ids; never the same twice."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    r = F.regexp_replace(F.uuid(), "-", "")
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(r, 14, 3), F.lit("-"), F.lit("a"), F.substring(r, 18, 3), F.lit("-"), F.substring(r, 21, 12))


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & (2**64 - 1)
    return h


def pointer(*parts: Any) -> str:
    """Short digest of a table version: 13 digits in base 36."""
    n, out = fnv1a64("|".join(map(str, parts)).encode()), ""
    while n:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out.rjust(13, "0")


def _number_text(v: float) -> str:
    if v == int(v) and abs(v) < 1e21:
        return str(int(v))
    s = repr(float(v))
    mantissa, _, exp = s.partition("e")
    if not exp:
        return s
    e = int(exp)
    if -7 < e < 0:
        return format(float(v), f".{len(mantissa.replace('.', '').replace('-', '')) - 1 - e}f")
    return f"{mantissa.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical(v: Any) -> str:
    """JSON with sorted keys, no spaces, and numbers as JavaScript prints them."""
    kind = kind_of(v)
    if kind == "object":
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v[k])}" for k in sorted(v)) + "}"
    if kind == "array":
        return "[" + ",".join(map(canonical, v)) + "]"
    if kind == "number":
        if not math.isfinite(v):
            raise EngineError("SchemaError", "JSON has finite numbers only")
        return _number_text(v)
    return json.dumps(v, ensure_ascii=False)


def canonical_col(body: Column) -> Column:
    """Canonical text of a VARIANT by Spark's own writer (sorted keys; numbers as Spark prints them)."""
    return F.to_json(body)


# The leading byte of each kind of index key, in sort order.
TAGS = {"null": 0x10, False: 0x20, True: 0x21, "number": 0x30, "string": 0x40, "object": 0x50}


def _number_bits(n: float) -> bytes:
    if math.isnan(n):
        raise EngineError("SchemaError", "NaN cannot be indexed")
    bits = struct.unpack(">Q", struct.pack(">d", n + 0.0))[0]
    if n == 0:
        bits = 0
    return struct.pack(">Q", bits ^ (2**64 - 1) if bits >> 63 else bits | 1 << 63)


def index_bytes(v: Any) -> bytes:
    """Bytes whose order is null, false, true, numbers, strings by UTF-8, objects."""
    kind = kind_of(v)
    if kind == "null":
        return bytes([TAGS["null"]])
    if kind == "boolean":
        return bytes([TAGS[v]])
    if kind == "number":
        return bytes([TAGS["number"]]) + _number_bits(float(v))
    if kind == "string":
        return bytes([TAGS["string"]]) + v.encode("utf-8", "replace")
    return bytes([TAGS["object"]]) + json.dumps(v, ensure_ascii=False, separators=(",", ":")).encode()


def index_key(v: Any) -> str:
    """Order-preserving key in base 32, the last digit padded with zero bits."""
    data = index_bytes(v)
    digits = -(-len(data) * 8 // 5)
    n = int.from_bytes(data, "big") << (digits * 5 - len(data) * 8)
    return base32(n, digits)


def index_key_col(value: Column, kind: str) -> Column:
    """``index_key`` of a typed column; an Arrow-batched function, as Spark has no base 32."""
    if kind == "number":
        value = value.cast("double")

    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v is pd.NA else index_key(v), na_action="ignore" if kind != "number" else None)

    encode.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.when(value.isNotNull(), F.pandas_udf(encode, "string")(F.coalesce(value, F.lit(0.0)) if kind == "number" else value))


def string_key_hex_col(value: Column) -> Column:
    """The bytes of a string's index key in hexadecimal: built in, and in the same order."""
    return F.lower(F.concat(F.lit("40"), F.hex(F.encode(value, "UTF-8"))))


def int_key_hex_col(value: Column) -> Column:
    """The bytes of a whole non-negative number's order-preserving form, in hexadecimal (16 digits)."""
    return F.lower(F.lpad(F.hex(value.cast("bigint")), 16, "0"))


def cursor(generation: str, name: str | None) -> str:
    return f"{generation}.{name or '-'}"


def parse_cursor(text: str) -> tuple[str | None, int | None]:
    """(generation, sequence number) of ``<generation>.<name>``, ``<generation>.-`` or a bare name."""
    if not text:
        return None, None
    generation, dot, name = text.rpartition(".")
    if not dot:
        return None, parse_lsn(name)[2]
    return generation, None if name == "-" else parse_lsn(name)[2]
