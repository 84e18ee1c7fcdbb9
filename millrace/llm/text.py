"""Small per-row helpers shared by the corpus operators.

A word is a run of characters other than space and TAB..CR (the pattern
``[^\\x20\\x09-\\x0D]+``). ``bytes.split()`` splits UTF-8 text at exactly those
six characters, and ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole value."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


class WordHashes(dict):
    """Hash of each word, remembered for frequent words; memory is bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; the whole sequence if it is shorter."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = mix(out * _A + hashes[i : i + n] * _B)
    return out


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and `raw`: the text's UTF-8 bytes, empty for a null."""
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))


def count_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def each(batch: pa.RecordBatch, column: str) -> Iterator:
    """A column's values one by one: a batch of long texts is not held twice."""
    for value in batch.column(column):
        yield value.as_py()
