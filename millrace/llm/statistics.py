"""Statistics of one whole text, from its UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from millrace.llm.text import WordHashes, windows

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

_SPACES, _SYMBOLS = np.frombuffer(SPACES, np.uint8), np.frombuffer(SYMBOLS, np.uint8)
_CONTINUATION = slice(0x80, 0xC0)


def repeated_words(hashes: np.ndarray, size: int = 5) -> int:
    """Words inside windows of `size` words that occur at least twice."""
    if len(hashes) <= size:
        return 0
    grams = windows(hashes, size)
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    repeats = 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeats += 1
        elif not line.isspace() and line:
            seen.add(line)
    return repeats


#: The counts that text_counts returns, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_digits", "n_punctuation", "n_marks")


def text_counts(raw: bytes, hashes: WordHashes) -> tuple[int, ...]:
    words = raw.split()
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(by_byte[_CONTINUATION].sum())
    return (
        len(words),
        points - int(by_byte[_SPACES].sum()),
        int(by_byte[_SYMBOLS].sum()),
        repeated_lines(raw),
        repeated_words(hashes.of(words)),
        len(set(words)),
        int(by_byte[10]) + 1,
        int(by_byte[65:91].sum()),
        int(by_byte[48:58].sum()),
        int(by_byte[[33, 44, 46, 58, 59, 63]].sum()),
        int(by_byte[33]),
    )
