"""Byte and text features of payloads, as JVM-side expressions where Spark has them."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: what separates text tokens.
SPLIT = r"[ \t\r\n?&=/]+"
#: Sizes of the blocks of the payload vector, and the window of its ordered block.
HISTOGRAM, DERIVED, HASHED, STRUCTURE, ORDERED = 256, 3, 2048, 16, 256
VECTOR_SIZE = HISTOGRAM + DERIVED + HASHED + STRUCTURE + ORDERED


def latin(payload: Column | str) -> Column:
    """Bytes as text, one character a byte."""
    return F.decode(F.col(payload) if isinstance(payload, str) else payload, "ISO-8859-1")


def printable_ratio(payload: str) -> Column:
    """Share of printable bytes (space to tilde, tab, line ends); null for an empty payload."""
    kept = F.length(F.regexp_replace(latin(payload), r"[^ -~\t\r\n]", ""))
    return F.try_divide(kept, F.length(payload))


KINDS = ("b4", "b8", "t")
_PRINTABLE = bytes([*range(0x20, 0x7F), 9, 10, 13])
_SPLIT = re.compile(SPLIT)


def token_list(raw: bytes | None, cap: int | None = 200, kinds: tuple[str, ...] = KINDS) -> list[str]:
    """Distinct tokens of one payload in order of generation, the first ``cap`` of them; stops there."""
    if not raw:
        return []
    found: dict[str, None] = {}
    digits, n = raw.hex(), len(raw)
    for kind in kinds:
        if cap is not None and len(found) >= cap:
            break
        if kind == "t":
            if n - len(raw.translate(None, _PRINTABLE)) > 0.7 * n:
                found.update(dict.fromkeys("t:" + s for s in _SPLIT.split(raw.decode("latin-1").lower()) if 2 <= len(s) <= 64))
            continue
        size, stride = (8, 2) if kind == "b4" else (16, 8)
        starts = range(0, 2 * n - size + 1, stride)
        step = len(starts) if cap is None else 2 * cap
        for at in range(0, len(starts), step or 1):
            found.update(dict.fromkeys(f"{kind}:{digits[i : i + size]}" for i in starts[at : at + step]))
            if cap is not None and len(found) >= cap:
                break
    return list(found) if cap is None else list(found)[:cap]


def tokens(payload: str, cap: int | None = 200, kinds: tuple[str, ...] = KINDS) -> Column:
    """Distinct tokens of a payload in order of generation, the first ``cap`` of them (None: all).

    Sliding 4-byte grams ``b4:``, then 8-byte grams every 4 bytes ``b8:``, then - if
    more than 70 % of the bytes are printable - lower-case text pieces ``t:`` of 2 to 64
    characters. A null or empty payload has no tokens. An Arrow function, as a lambda per gram is slower.
    """

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([token_list(None if v is None else bytes(v), cap, kinds) for v in values], dtype="object")

    return run(payload)


def token_rows(df: DataFrame, keep: Sequence[str], payload: str, cap: int | None = None, kinds: tuple[str, ...] = KINDS, only: frozenset[str] | None = None, chunk: int = 200_000) -> DataFrame:
    """``keep`` columns and ``token``, one row per distinct token of a payload (see ``tokens``), of those in ``only`` if given (a model's vocabulary).

    Rows leave in batches of about ``chunk``, however long the payloads are, so memory is bounded by the longest one.
    """
    cols, types = list(keep), dict(df.dtypes)
    wanted = None if only is None else df.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        for b in batches:
            rows: list[int] = []
            found: list[str] = []
            for i, raw in enumerate(b.column("_payload")):
                own = token_list(raw.as_py(), cap, kinds)
                if known is not None:
                    own = [t for t in own if t in known]
                rows += [i] * len(own)
                found += own
                if found and (len(found) >= chunk or i + 1 == b.num_rows):  # the last one may have no token of its own
                    at = pa.array(rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in cols], pa.array(found, pa.string())], [*cols, "token"])
                    rows, found = [], []

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cols), "token string"])
    return df.select(*cols, F.col(payload).alias("_payload")).mapInArrow(run, schema)


def token_counts(df: DataFrame, label: str, payload: str, kinds: tuple[str, ...] = KINDS, most: int = 500_000) -> DataFrame:
    """token, ``label`` (a string), n: payloads that hold a token, by label. Counted in the worker first, at most ``most`` tokens at a time, so a token that all payloads share leaves once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, Counter] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([name] * len(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["token", label, "n"])
            counts.clear()

        for b in batches:
            for name, raw in zip(b.column(label), b.column("_payload"), strict=True):
                own = token_list(raw.as_py(), None, kinds)
                counts.setdefault(name.as_py(), Counter()).update(own)
                held += len(own)
                if held >= 4 * most:
                    held = sum(map(len, counts.values()))
                    if held >= most:
                        yield from flush()
                        held = 0
        yield from flush()

    parts = df.select(F.col(label).cast("string").alias(label), F.col(payload).alias("_payload")).mapInArrow(run, f"token string, `{label}` string, n long")
    return parts.groupBy("token", label).agg(F.sum("n").alias("n"))


def byte_values(payload: str) -> Column:
    """The bytes as an array of 0..255."""
    places = F.sequence(F.lit(1), F.length(payload))
    values = F.transform(places, lambda i: F.conv(F.hex(F.substring(F.col(payload), i, F.lit(1))), 16, 10).cast("int"))
    return F.when(F.length(payload) > 0, values).otherwise(F.array().cast("array<int>"))


def byte_counts(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, byte, n: how often each byte value occurs in each payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            counts = np.stack([np.bincount(np.frombuffer(bytes(v or b""), dtype=np.uint8), minlength=256) for v in b[payload]])
            row, byte = np.nonzero(counts)
            yield pd.DataFrame({key: b[key].to_numpy()[row], "byte": byte, "n": counts[row, byte]})

    rows = df.select(key, payload).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, byte int, n long")
    return rows.groupBy(key, "byte").agg(F.sum("n").alias("n"))


def byte_profile(counts: DataFrame, key: str) -> DataFrame:
    """Entropy in bits, and the shares of printable bytes (0x20 up to 0x7E) and zeros, from ``byte_counts``."""
    total = F.sum("n").over(W.partitionBy(key))
    p = F.col("n") / total
    rows = counts.withColumn("_p", p)
    return rows.groupBy(key).agg(
        (-F.sum(F.col("_p") * F.log2(F.col("_p") + 1e-12))).alias("entropy"),
        F.sum(F.when(F.col("byte").between(0x20, 0x7E), F.col("_p")).otherwise(0.0)).alias("printable"),
        F.sum(F.when(F.col("byte") == 0, F.col("_p")).otherwise(0.0)).alias("zeros"),
    )


def hashed_grams(df: DataFrame, key: str, payload: str, buckets: int = HASHED) -> DataFrame:
    """key, bucket, share: 4-byte windows hashed by md5 into buckets, as shares of the windows."""
    n = F.length(payload)
    windows = F.when(n >= 4, F.transform(F.sequence(F.lit(1), n - 3), lambda i: F.substring(F.col(payload), i, F.lit(4))))
    rows = df.select(key, (n - 3).alias("_w"), F.explode(windows).alias("g"))
    bucket = F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("long") % buckets
    return rows.groupBy(key, bucket.cast("int").alias("bucket")).agg((F.count(F.lit(1)) / F.max("_w")).alias("share"))


def ordered_bytes(payload: str, size: int = ORDERED) -> Column:
    """Bytes / 255 in order, cut or padded with 0 to ``size``."""
    values = F.transform(F.slice(byte_values(payload), 1, size), lambda b: b / 255.0)
    return F.concat(values, F.array_repeat(F.lit(0.0), size - F.size(values)))


def http_structure(payload: str) -> dict[str, Column]:
    """Sixteen features of HTTP and text structure; give a cut payload for a window. The longest run needs ``longest_run``."""
    s = latin(payload)

    def count(pattern: str) -> Column:
        return (F.length(s) - F.length(F.regexp_replace(s, pattern, ""))).cast("double")

    request = s.rlike(r"^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) ")
    url = F.when(request, F.get(F.split(F.regexp_extract(s, r"(?s)^(.*?)(?:\r\n|\z)", 1), " "), F.lit(1)))
    cut = F.instr(s, "\r\n\r\n")
    low = F.lower(s)
    return {
        "is_http_request": request.cast("double"),
        "is_http_response": s.rlike(r"^HTTP/").cast("double"),
        "url_length": F.coalesce(F.length(url), F.lit(0)).cast("double"),
        "n_query_params": F.when(F.contains(url, F.lit("?")), F.length(url) - F.length(F.replace(url, F.lit("&"), F.lit(""))) + 1).otherwise(0).cast("double"),
        "n_special_chars": count(r"""[<>'";&%=(){}\[\]\\]"""),
        "content_type_textlike": (F.contains(low, F.lit("text/")) | F.contains(low, F.lit("application/json"))).cast("double"),
        "has_multipart": F.contains(low, F.lit("multipart/form-data")).cast("double"),
        "header_length_est": F.when(cut > 0, cut - 1).otherwise(F.length(s)).cast("double"),
        "body_length_est": F.when(cut > 0, F.length(s) - cut - 3).otherwise(0).cast("double"),
        "n_uppercase": count(r"[A-Z]"),
        "n_digits": count(r"[0-9]"),
        "n_alpha": count(r"[A-Za-z]"),
        "n_null_bytes": count(r"\x00"),
        "n_newlines": count(r"\n"),
        "n_tabs": count(r"\t"),
    }


def longest_run(payload: str) -> Column:
    """Length of the longest stretch of one repeated byte."""
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, b: Column) -> Column:
        run = F.when(a["b"] == b, a["run"] + 1).otherwise(1)
        return F.struct(b.alias("b"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(byte_values(payload), start, step)["best"]


def preview(payload: str, size: int) -> tuple[Column, Column]:
    """Hexadecimal and ASCII preview; other bytes show as dots."""
    head = F.substring(payload, 1, size)
    return F.lower(F.hex(head)), F.regexp_replace(latin(head), r"[^ -~]", ".")


def padded_payload(payload: str, length: str, limit: int | None = None) -> Column:
    """The payload without padding beyond its length (and ``limit``)."""
    n = F.greatest(F.lit(0), F.least(F.col(length), F.length(payload)))
    return F.substring(F.col(payload), F.lit(1), F.least(n, F.lit(limit)) if limit else n)


_ENTITY = re.compile(rb"&(#[xX]?[0-9a-fA-F]+);")


def _entities(raw: bytes) -> bytes:
    for name in ("amp", "lt", "gt", "quot", "apos"):
        raw = raw.replace(b"&" + name.encode() + b";", html.unescape(f"&{name};").encode())

    def number(m: re.Match[bytes]) -> bytes:
        body = m.group(1)[1:]
        try:
            return bytes([(int(body[1:], 16) if body[:1] in b"xX" else int(body)) & 0xFF])
        except ValueError:
            return m.group()

    return _ENTITY.sub(number, raw)


def _unbase64(raw: bytes) -> bytes:
    import base64
    import binascii

    bare = bytes(b for b in raw if b not in b"\r\n\t ")
    if not bare or len(bare) % 4:
        return raw
    try:
        return base64.b64decode(bare)
    except binascii.Error:
        return raw


DECODERS = {"lowercase": bytes.lower, "url_decode": unquote_to_bytes, "html_entity_decode": _entities, "base64_decode": _unbase64}


def decoded(payload: Column | str, steps: tuple[str, ...]) -> Column:
    """Bytes after the given ``DECODERS``, in order. An Arrow function: Spark has no decoder that keeps malformed escapes."""
    unknown = set(steps) - set(DECODERS)
    if unknown:
        raise ValueError(f"unknown decoders {sorted(unknown)}")

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            if v is not None:
                v = bytes(v)
                for s in steps:
                    v = DECODERS[s](v)
            out.append(v)
        return pd.Series(out)

    return run(payload)


def payload_vectors(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key and ``vector``: histogram, its profile, hashed grams, structure and ordered bytes, ``VECTOR_SIZE`` floats."""
    kinds = dict(df.dtypes)
    names = list(http_structure(payload))
    rows = df.select(key, payload, F.array(*[F.coalesce(c, F.lit(0.0)) for c in http_structure(payload).values()]).alias("_structure"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import md5

        for b in batches:
            out = []
            for raw, structure in zip(b[payload], b["_structure"], strict=True):
                raw = bytes(raw or b"")
                v = np.zeros(VECTOR_SIZE, dtype=np.float32)
                if raw:
                    a = np.frombuffer(raw, dtype=np.uint8)
                    h = np.bincount(a, minlength=HISTOGRAM) / len(a)
                    v[:HISTOGRAM] = h
                    at = HISTOGRAM
                    v[at : at + DERIVED] = -(h * np.log2(h + 1e-12)).sum(), h[0x20:0x7F].sum(), h[0]
                    at += DERIVED
                    if len(raw) > 3:
                        seen, n = np.unique(np.lib.stride_tricks.sliding_window_view(a, 4), axis=0, return_counts=True)
                        where = [int.from_bytes(md5(g.tobytes()).digest()[:4], "big") % HASHED for g in seen]
                        np.add.at(v, at + np.array(where), n / (len(raw) - 3))
                    at += HASHED
                    v[at : at + len(names)] = structure
                    edges = np.flatnonzero(np.diff(a)) + 1
                    v[at + len(names)] = np.diff(np.concatenate([[0], edges, [len(a)]])).max()
                    at += STRUCTURE
                    v[at : at + min(len(a), ORDERED)] = a[:ORDERED] / 255.0
                out.append(v)
            yield pd.DataFrame({key: b[key], "vector": out})

    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, vector array<float>")


def from_aliases(df: DataFrame, binary: tuple[str, ...] = (), hexadecimal: tuple[str, ...] = (), text: tuple[str, ...] = ()) -> Column:
    """The first payload found under several names: bytes, hexadecimal text (an odd last digit is cut off), plain text. Missing columns are skipped."""
    there = set(df.columns)
    tries = [F.col(c).cast("binary") for c in binary if c in there]
    for c in hexadecimal:
        if c in there:
            even = F.substring(F.col(c), F.lit(1), F.length(c) - F.length(c) % 2)
            tries.append(F.when(F.col(c).rlike(r"^[0-9A-Fa-f]+$"), F.unhex(even)))
    tries += [F.encode(F.col(c), "UTF-8") for c in text if c in there]
    return F.coalesce(*tries, F.lit(None).cast("binary"))
