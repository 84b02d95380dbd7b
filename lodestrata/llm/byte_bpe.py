"""Byte-level BPE encoding and decoding of whole texts with the tiktoken library.

The rank file is read once on the driver (its size is checked) and shipped to the
executors. Long texts are cut at safe boundaries first, so that the splitting regex never
holds more than a block of text; ids are those of the uncut text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_bytes, table

#: A text is cut into blocks of about so many characters.
BLOCK_CHARS = 1 << 17

#: Where a block may end. Before one space or line feed that stands between two letters or digits of any script: no
#: alternative of the splitting pattern holds white space except at its start, and a single white space
#: before a letter belongs to what follows (space) or is a match of its own (line feed). And, for scripts that need no spaces, between
#: a letter and a full stop, comma or the like: a run of letters ends there, and what follows begins a match.
_LETTERS = "\u0620-\u064a\u0905-\u0939\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3"
_SAFE = re.compile(rf"(?<=[^\W_])(?=[ \n][^\W_])|(?<=[{_LETTERS}])(?=[\u060c\u061b\u061f\u06d4\u0964\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")

_encodings: dict[tuple[str, str], object] = {}


def encoding_of(ranks_file: bytes, pattern: str):
    """The library's encoding for a rank file, kept per worker."""
    import tiktoken

    key = (hashlib.sha256(ranks_file).hexdigest(), pattern)
    if key not in _encodings:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in ranks_file.splitlines() if line)}
        _encodings.clear()
        _encodings[key] = tiktoken.Encoding(key[0][:16], pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in blocks that end at safe boundaries; a text without any stays whole."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(encoding, text: str, size: int = BLOCK_CHARS) -> np.ndarray:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    if len(text) <= size:
        return np.array(encoding.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(encoding.encode_ordinary(part), dtype="<u4") for part in blocks(text, size)])


def decode(encoding, ids: np.ndarray, step: int = 1 << 16) -> bytes:
    """The raw bytes of ids: a piece may end inside a character, so bytes are joined before any text decoding."""
    return b"".join(encoding.decode_bytes(ids[i : i + step].tolist()) for i in range(0, len(ids), step))


def encode_column(docs: DataFrame, text: str, ranks_file: bytes, pattern: str, with_ids: bool = False):
    """A column struct<n_tokens, ids_sha256, decoded_sha256[, ids]> over a text column; null counts as empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks_file)
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoding = encoding_of(shipped.value, pattern)
        for batch in batches:
            rows = []
            for value in batch:
                ids = encode(encoding, value or "")
                raw = ids.tobytes()
                row = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decode(encoding, ids)).hexdigest())
                rows.append((*row, raw) if with_ids else row)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return of(F.col(text))


def encode_documents(docs: DataFrame, ranks_file: bytes, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids as bytes, if asked for) of every document.

    Null texts are empty texts: no ids and the hash of nothing. Repeated rows and null doc_ids
    give a row each; an empty table gives no rows; other columns are not read.
    """
    narrow = docs.select("doc_id", F.col("text").alias("text"))
    out = narrow.select("doc_id", encode_column(narrow, "text", ranks_file, pattern, with_ids).alias("e"))
    return out.select("doc_id", "e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks_file = file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_documents(table(spark, sf_dir, "documents"), ranks_file, public_tokenizers.PATTERN)


QUERIES = {"op7_byte_bpe": query}
