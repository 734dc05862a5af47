"""Sizes of texts in tokens of a public byte-level tokenizer.

The vocabulary is a file of base64 tokens and ranks, whose path is a parameter;
it is loaded once in each Python worker. Counts are exact: a text is cut only
where the tokenizer cuts it for certain (before a run of white space), and the
counts of the pieces, most of which recur, are kept.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies unless a caller or TRILOOM_TOKENIZER says otherwise.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The fixed split pattern of this family of tokenizers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_KEPT = 1_000_000
_WIDE = re.compile(r"\s (?:\s|\Z)")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PIECE = re.compile(r"\s+\S*|\S+")
_loaded: dict = {}


def vocabulary_path(path: str | None = None) -> str:
    return path or os.environ.get("TRILOOM_TOKENIZER", DEFAULT_VOCABULARY)


def encoding(path: str) -> object:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Counts(dict):
    """Token counts of pieces, filled on demand and emptied when they grow too many."""

    def __init__(self, encode: object, prefix: str) -> None:
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(self.prefix + piece))
        if len(piece) <= 100:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, path: str) -> None:
        self.encode = encoding(path).encode_ordinary
        self.spaced, self.any = _Counts(self.encode, " "), _Counts(self.encode, "")

    def __call__(self, text: str | None) -> int | None:
        if text is None:
            return None
        if _SEPARATORS.search(text):  # white space to one of the two pattern engines only
            return len(self.encode(text))
        if _WIDE.search(text):
            return sum(map(self.any.__getitem__, _PIECE.findall(text)))
        first, *rest = text.split(" ")
        return (self.any[first] if first else 0) + sum(map(self.spaced.__getitem__, rest))


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def with_tokens(texts: DataFrame, text: str = "text", into: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """`texts` without its text column, and with the text's number of tokens instead. A null text has 0 tokens."""
    path = vocabulary_path(vocabulary)
    keep = [c for c in texts.columns if c != text]
    if into in keep:
        raise ValueError(f"there is a column {into!r} already")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for b in batches:
            n = pa.array([tokens(x) or 0 for x in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, into])

    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(*keep, F.col(text)).mapInArrow(count, f"{schema}, `{into}` bigint")
