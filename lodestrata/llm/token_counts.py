"""Token counts of whole texts without token ids of the texts.

A text's tokens are the tokens of its pre-tokens, and pre-tokens repeat. Texts go through in
blocks of bounded size: the frequencies of each text's pre-tokens are joined to a table of pre-tokens
and their counts that a worker keeps for all its blocks, and summed. A pre-token that is not in the table is
counted by the library, once, together with all others that a block brings. The table is bounded: it has a young
and an old half, and when the young one is full the old one is given up. Blocks are independent, so nothing is
shuffled and a lost executor repeats its blocks only.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_bytes, table

#: A block ends when its texts reach so many characters; a longer text is a block of its own.
BLOCK_CHARS = 4 << 20
#: Pre-tokens in a half of a worker's table, and characters of the longest one that is kept there.
MOST_PIECES, LONGEST = 1 << 19, 64

_SEPARATORS = "\x1c\x1d\x1e\x1f"

_loaded: dict[int, tuple] = {}


class PieceCounter:
    """Counts the tokens of texts as a tokenizers .json file gives them."""

    def __init__(self, json_file: bytes, pattern: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(json_file.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = latin_finder(pattern) or regex.compile(pattern).findall
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

    def pre_tokens(self, text: str) -> tuple[Counter, int]:
        """Frequencies of a text's pre-tokens, and how many added tokens stand in it."""
        specials, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            specials = len(parts) - 1
        found: Counter = Counter()
        for part in parts:
            found.update(self._split(part))
        return found, specials

    def _split(self, part: str) -> list[str]:
        # the library's own tables decide what is a letter or number beyond Latin-1, and it takes four separators for no white space
        try:
            part.encode("latin-1")
            plain = not any(c in part for c in _SEPARATORS)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return self.find(part)

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        encoded = self.tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False) if pre_tokens else []
        return [len(e.ids) for e in encoded]

    def totals(self, texts: list[str]) -> list[int]:
        """Token counts of a block of texts."""
        young, old = self.young, self.old
        split = [self.pre_tokens(t) for t in texts]
        met = [list(map(young.get, f)) for f, _ in split]
        missing = dict.fromkeys(p for (f, _), counts in zip(split, met, strict=True) if None in counts for p, n in zip(f, counts, strict=True) if n is None)
        counted = {p: old[p] for p in missing if p in old}
        new = [p for p in missing if p not in counted]
        counted.update(zip(new, self.pieces(new), strict=True))
        out = []
        for (f, specials), counts in zip(split, met, strict=True):
            if None in counts:
                counts = [counted[p] if n is None else n for p, n in zip(f, counts, strict=True)]
            out.append(sum(map(mul, counts, f.values())) + specials)
        if len(young) + len(counted) > MOST_PIECES:
            self.old, self.young = young, {}
        self.young.update((p, n) for p, n in counted.items() if len(p) <= LONGEST)
        return out


def latin_finder(pattern: str):
    """findall of the pattern for texts of Latin-1 without _SEPARATORS, where its letters and numbers can be written out and the
    faster module finds the same matches; None if the pattern holds other properties."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c)).startswith(kind))
    for kind in "LN":
        chars, mark = of(kind), rf"\p{{{kind}}}"
        inside = re.compile(r"(\[[^\]]*)" + re.escape(mark))
        while inside.search(pattern):
            pattern = inside.sub(lambda m: m[1] + chars, pattern)
        pattern = pattern.replace(mark, f"[{chars}]")
    return None if r"\p{" in pattern or r"\P{" in pattern else re.compile(pattern).findall


def _counter(json_file: bytes, pattern: str) -> PieceCounter:
    key = hash((json_file, pattern))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceCounter(json_file, pattern)
    return _loaded[key]


def count_tokens(docs: DataFrame, json_file: bytes, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document.

    A null text is an empty text: 0 bytes and 0 tokens. A very long text is counted whole, as a block of its own. Repeated
    rows and null doc_ids give a row each; an empty table gives no rows; other columns are not read, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(json_file)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(shipped.value, pattern)
        for batch in batches:
            out, block, size = [], [], 0
            for value in batch:
                block.append(value or "")
                size += len(block[-1])
                if size >= BLOCK_CHARS:
                    out += counter.totals(block)
                    block, size = [], 0
            yield pd.Series(out + counter.totals(block), dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    json_file = file_bytes(public_tokenizers.path("byte_bpe_50k.json"))
    return count_tokens(table(spark, sf_dir, "documents"), json_file, public_tokenizers.PATTERN)


QUERIES = {"op6_token_counts": query}
