"""TLS features of payloads: record walk and client hello fingerprint."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Record types, and the reserved values a client sprinkles in (GREASE).
RECORD_TYPES = range(0x14, 0x18)
HANDSHAKE, CLIENT_HELLO, SERVER_NAME, GROUPS, POINTS, PROTOCOLS = 0x16, 1, 0, 10, 11, 16


def is_grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A and v >> 8 == v & 0xFF


def record_sizes(raw: bytes) -> list[int]:
    """Body sizes of the TLS records a payload starts with; stops at the first thing that is none."""
    out, at = [], 0
    while at + 5 <= len(raw) and raw[at] in RECORD_TYPES and raw[at + 1] == 3:
        size = int.from_bytes(raw[at + 3 : at + 5], "big")
        out.append(size)
        at += 5 + size
    return out


def _words(b: bytes) -> Iterator[int]:
    for i in range(0, len(b) - 1, 2):
        v = int.from_bytes(b[i : i + 2], "big")
        if not is_grease(v):
            yield v


def client_hello(raw: bytes) -> dict | None:
    """JA3 text and digest, server name and application protocols of a client hello; None for anything else or cut-off hellos."""
    if len(raw) < 11 or raw[0] != HANDSHAKE or raw[5] != CLIENT_HELLO:
        return None
    try:
        version, at = int.from_bytes(raw[9:11], "big"), 43
        at += 1 + raw[at]
        n = int.from_bytes(raw[at : at + 2], "big")
        ciphers = list(_words(raw[at + 2 : at + 2 + n]))
        at += 2 + n
        at += 1 + raw[at]
        end = at + 2 + int.from_bytes(raw[at : at + 2], "big")
        at += 2
        if end > len(raw):
            return None
        kinds, groups, points, name, protocols = [], [], [], None, []
        while at + 4 <= end:
            kind, size = int.from_bytes(raw[at : at + 2], "big"), int.from_bytes(raw[at + 2 : at + 4], "big")
            body = raw[at + 4 : at + 4 + size]
            at += 4 + size
            if is_grease(kind):
                continue
            kinds.append(kind)
            if kind == SERVER_NAME and len(body) > 5:
                name = body[5 : 5 + int.from_bytes(body[3:5], "big")].decode("ascii", "replace")
            elif kind == GROUPS:
                groups = list(_words(body[2:]))
            elif kind == POINTS:
                points = list(body[1:])
            elif kind == PROTOCOLS:
                i = 2
                while i < len(body):
                    protocols.append(body[i + 1 : i + 1 + body[i]].decode("ascii", "replace"))
                    i += 1 + body[i]
    except IndexError:
        return None
    text = ",".join([str(version), *("-".join(map(str, x)) for x in (ciphers, kinds, groups, points))])
    return {"ja3": text, "ja3_md5": hashlib.md5(text.encode()).hexdigest(), "sni": name, "alpn": protocols}


_TEXT = T.StringType()
_HELLO = T.StructType([T.StructField(n, t) for n, t in (("ja3", _TEXT), ("ja3_md5", _TEXT), ("sni", _TEXT), ("alpn", T.ArrayType(_TEXT)))])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _record_sizes(values: pd.Series) -> pd.Series:
    return values.map(lambda v: record_sizes(bytes(v)) if v is not None else None)


@F.pandas_udf(_HELLO)
def _client_hello(values: pd.Series) -> pd.DataFrame:
    none = {"ja3": None, "ja3_md5": None, "sni": None, "alpn": None}
    return pd.DataFrame([(client_hello(bytes(v)) if v is not None else None) or none for v in values], columns=list(none))


def tls_record_sizes(payload: Column | str) -> Column:
    return _record_sizes(payload)


def tls_client_hello(payload: Column | str) -> Column:
    """Struct of ja3, ja3_md5, sni, alpn; all null where there is no client hello."""
    return _client_hello(payload)
