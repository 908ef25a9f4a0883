"""Encoding of texts with a public byte-level BPE given as a rank file."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie on every machine; a parameter of all operators here.
TOKENIZERS = os.environ.get("SKEINFLOW_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-splitting pattern published with byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are cut at safe places before the pattern sees them.
LONG = 100_000
#: Texts whose ids are held at once.
PIECE = 500

_SAFE = regex.compile(r"(?<=\S)(?=\s)")
_PIECE = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a rank file: one line per token, base64 bytes and rank."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_cuts(text: str, size: int) -> Iterator[str]:
    """Pieces of about ``size`` characters whose encodings, joined, are the encoding of the whole.

    A place where a blank follows something else is always a boundary of the
    pattern: no alternative goes on over it, and what lies left of it ends with a
    non-blank, so look-ahead sees the same on both sides of the cut.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, enc, long: int = LONG) -> list[int]:
    """Token ids of a text without special tokens; null and empty texts give [].

    Strings that look like special tokens are ordinary text. A stretch of ``long``
    characters or more without any safe place (one endless word) is matched
    piece by piece and each piece encoded as raw bytes, which needs no
    backtracking over the stretch.
    """
    if not text:
        return []
    if len(text) <= long:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in safe_cuts(text, long):
        if len(piece) <= 2 * long:
            out += enc.encode_ordinary(piece)
        else:
            for m in _PIECE.finditer(piece):
                out += enc._encode_single_piece(m.group())
    return out


def _mapper(columns: list[str], text: str, path: str, make: Callable, schema_col: str):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for batch in batches:
            for start in range(0, len(batch), PIECE):  # ids of a whole Arrow batch of long texts would be held at once
                b = batch.iloc[start : start + PIECE]
                out = b[columns].copy()
                out[schema_col] = [make(t, enc) for t in b[text]]
                yield out

    return run


def _typed(df: DataFrame, columns: list[str], extra: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), extra])


def encode_corpus(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ``ids``, the token ids of every text; [] for null and empty ones.

    Only the named columns are read, whatever else the table holds. No shuffle:
    each input split is encoded where it is read.
    """
    cols = list(keep)
    run = _mapper(cols, text, os.path.join(folder, vocabulary), lambda t, enc: np.array(encode(t, enc), dtype=np.int32), "ids")
    return docs.select(*dict.fromkeys([*cols, text])).mapInPandas(run, _typed(docs, cols, "ids array<int>"))


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ``n_tokens``, without sending the ids back to the JVM."""
    cols = list(keep)
    run = _mapper(cols, text, os.path.join(folder, vocabulary), lambda t, enc: len(encode(t, enc)), "n_tokens")
    return docs.select(*dict.fromkeys([*cols, text])).mapInPandas(run, _typed(docs, cols, "n_tokens long"))


def decode_corpus(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ``raw``, the exact UTF-8 bytes behind the ids; null ids give empty bytes.

    Bytes, not text: a list cut inside a character still decodes to what it holds.
    """
    cols = list(keep)
    run = _mapper(cols, ids, os.path.join(folder, vocabulary), lambda t, enc: b"" if t is None else enc.decode_bytes([int(i) for i in t]), "raw")
    return encoded.select(*dict.fromkeys([*cols, ids])).mapInPandas(run, _typed(encoded, cols, "raw binary"))


def round_trip(docs: DataFrame, **where: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes and whether decoding the ids gives the text's bytes back (null counts as empty)."""
    encoded = encode_corpus(docs, keep=("doc_id", "text"), **where)
    raw = decode_corpus(encoded, keep=("doc_id", "text", "ids"), **where)
    wanted = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return raw.select("doc_id", F.size("ids").alias("n_tokens"), F.length("raw").alias("n_bytes"), (F.col("raw") == wanted).alias("exact"))
