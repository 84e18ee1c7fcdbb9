"""Ids of public tokenizers for whole texts, in bounded memory.

A text is cut where its tokenizer would begin anew anyway, and the ids of a piece so
cut are remembered as bytes (four a number), so a piece that comes back is not
tokenised again. What is remembered is dropped when it reaches LIMIT pieces. Long
texts are taken a segment at a time; only what has no place to cut is held whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache, partial
from typing import Any

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

SEGMENT, BLOCK = 1 << 18, 1 << 18
LIMIT = 800_000

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores.


def vocabulary(name: str) -> str:
    """The file of a public tokenizer, or a path as it is."""
    return name if os.path.isabs(name) else public_tokenizers.path(name)


@cache
def tokenizer(path: str, plain: bool) -> Tokenizer:
    """`plain`: strings of special tokens in a text are ordinary text."""
    found = Tokenizer.from_file(vocabulary(path))
    found.encode_special_tokens = plain
    return found


@cache
def pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))


def packed(ids: Iterable[list[int]]) -> list[bytes]:
    return [np.array(x, "<u4").tobytes() for x in ids]


class Remembered(dict):
    """The ids of pieces of text, by their bytes; those of words that many tasks of a
    worker meet need not be found again."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]]) -> None:
        self.encode = encode

    def packed(self, chunks: list[bytes]) -> list[bytes]:
        got = list(map(self.get, chunks))
        if None in got:
            gaps = [i for i, x in enumerate(got) if x is None]
            names = list(dict.fromkeys(chunks[i] for i in gaps))
            new = dict(zip(names, self.encode(names)))
            for i in gaps:
                got[i] = new[chunks[i]]
            if len(self) + len(new) > LIMIT:
                self.clear()
            if len(new) <= LIMIT:
                self.update(new)
        return got

    def ids(self, chunks: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(self.packed(chunks)), "<u4")


def segments(raw: bytes, places: re.Pattern[bytes]) -> Iterator[bytes]:
    """`raw` in parts of SEGMENT bytes or more, each from a place to cut on."""
    at = 0
    while at < len(raw):
        place = places.search(raw, at + SEGMENT)
        end = place.start() if place else len(raw)
        yield raw[at:end]
        at = end


# Word ends: byte-level BPE that drops white space and letter case.

_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: A letter run ends before a mark, and nothing composes across: both are ASCII. An
#: apostrophe may belong to what follows it.
_MARK = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")


def words(raw: bytes) -> list[bytes]:
    """The pieces that a tokenizer with word ends treats one by one.

    Lowering and cutting off marks first makes more of them alike; it is left out where
    it could change a special token's string or what a combining mark composes with.
    """
    if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw:
        return raw.split()
    return _MARK.sub(b" ", raw.lower()).split()


#: Small letters of ASCII and Latin-1: nothing to lower, nothing to compose.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Bytes without a visible Latin-1 character are shown as those from 256 on.
_SHOWN = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_VISIBLE = {b: c for b, c in _SHOWN.items() if b > 0x7F}


@cache
def _merges(path: str) -> tuple[Tokenizer, np.ndarray]:
    """The tokenizer's model by itself, for words that need nothing else of it, and
    which of its ids end a word."""
    known = tokenizer(path, False)
    ends = np.zeros(known.get_vocab_size(), bool)
    for token, i in known.get_vocab().items():
        ends[i] = token.endswith("</w>")
    bare = Tokenizer(known.model)
    bare.pre_tokenizer = WhitespaceSplit()
    return bare, ends


def _encode_words(path: str, chunks: list[bytes]) -> list[bytes]:
    """Words of plain small letters are tokenised in lines; the ends that their ids
    carry tell them apart again."""
    bare, ends = _merges(path)
    out: list[bytes] = [b""] * len(chunks)
    ascii_only, latin, other = [], [], []
    for i, x in enumerate(chunks):
        (other if not _LETTERS.fullmatch(x) else ascii_only if x.isascii() else latin).append(i)
    for some in (x[at : at + 1000] for x in (ascii_only, latin) for at in range(0, len(x), 1000)):
        line = b" ".join(chunks[i] for i in some).decode("latin-1")
        line = line if line.isascii() else line.translate(_VISIBLE)
        ids = np.array(bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(ends[ids]) + 1
        if len(last) != len(some):
            raise ValueError(f"{path} does not end words")
        data = ids.tobytes()
        for i, start, end in zip(some, [0, *last[:-1].tolist()], last.tolist()):
            out[i] = data[4 * start : 4 * end]
    for at in range(0, len(other), 1000):
        some = other[at : at + 1000]
        found = tokenizer(path, False).encode_batch_fast([chunks[i].decode(errors="replace") for i in some], add_special_tokens=False)
        for i, ids in zip(some, packed(e.ids for e in found)):
            out[i] = ids
    return out


@cache
def _word_ids(path: str) -> Remembered:
    return Remembered(partial(_encode_words, path))


class WordTokens:
    """Ids of whole texts, equal to those of the tokenizer itself."""

    def __init__(self, path: str) -> None:
        self.known = _word_ids(path)

    def of(self, rows: Iterable[tuple[Any, bytes]]) -> Iterator[tuple[Any, np.ndarray, bool]]:
        """(key, ids, last) for each segment of each text, in order. Texts are looked up
        together, a quarter of a megabyte at a time."""
        block: list[tuple[Any, list[bytes], bool]] = []
        held = 0
        for key, raw in rows:
            left = len(raw)
            for part in segments(raw, _SPACE) if raw else (b"",):
                left -= len(part)
                block.append((key, words(part), not left))
                held += len(part)
                if held >= BLOCK:
                    yield from self._look_up(block)
                    block, held = [], 0
        yield from self._look_up(block)

    def _look_up(self, block: list[tuple[Any, list[bytes], bool]]) -> Iterator[tuple[Any, np.ndarray, bool]]:
        found = self.known.packed([x for _, chunks, _ in block for x in chunks])
        at = 0
        for key, chunks, last in block:
            yield key, np.frombuffer(b"".join(found[at : at + len(chunks)]), "<u4"), last
            at += len(chunks)


# A pair of tokenizers that both begin anew before a word: byte-level BPE, and pieces
# in which white space only leads.

#: First bytes of characters that are no white space anywhere; 0xC2 and 0xE1 to 0xE3
#: may begin some.
_NO_SPACE = rb"[!-~\xc3-\xe0\xe4-\xf4]"
_CUT = re.compile(rb"(?<=[^ ]) (?=" + _NO_SPACE + rb")")
_UNEVEN = re.compile(rb" (?!" + _NO_SPACE + rb")|^ ")
#: Stands for the ids of a piece whose tokens do not spell it.
BROKEN = 0xFFFFFFFF
_BROKEN = np.array([BROKEN], "<u4").tobytes()
_MARKER = "▁"


@cache
def byte_spellings(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    known = tokenizer(path, True)
    real = {chr(_SHOWN.get(b, b)): b for b in range(256)}
    added = {i: t.content.encode() for i, t in known.get_added_tokens_decoder().items()}
    return [added[i] if i in added else bytes(real[c] for c in known.id_to_token(i)) for i in range(known.get_vocab_size())]


@cache
def piece_spellings(path: str) -> list[bytes]:
    known = pieces(path)
    return [bytes([int(known.id_to_piece(i)[3:-1], 16)]) if known.is_byte(i) else known.id_to_piece(i).replace(_MARKER, " ").encode() for i in range(known.get_piece_size())]


def _encode_bytes(path: str, chunks: list[bytes]) -> list[bytes]:
    """Of space and chunk."""
    spelt, known = byte_spellings(path), tokenizer(path, True)
    out = []
    for at in range(0, len(chunks), 1000):
        some = chunks[at : at + 1000]
        found = known.encode_batch_fast([" " + x.decode(errors="replace") for x in some], add_special_tokens=False)
        out += [np.array(e.ids, "<u4").tobytes() if b"".join(map(spelt.__getitem__, e.ids)) == b" " + x else _BROKEN for e, x in zip(found, some)]
    return out


def _encode_pieces(path: str, chunks: list[bytes]) -> list[bytes]:
    """Of the chunk, to which the tokenizer adds the space."""
    spelt, known = piece_spellings(path), pieces(path)
    out = []
    for at in range(0, len(chunks), 1000):
        some = chunks[at : at + 1000]
        found = known.encode([x.decode(errors="replace") for x in some], num_threads=1)
        out += [np.array(ids, "<u4").tobytes() if b"".join(map(spelt.__getitem__, ids)) == b" " + x else _BROKEN for ids, x in zip(found, some)]
    return out


@cache
def _pair(bytes_path: str, pieces_path: str) -> tuple[Remembered, Remembered]:
    spelt = {x for x in (pieces(pieces_path).id_to_piece(i) for i in range(pieces(pieces_path).get_piece_size())) if _MARKER in x.lstrip(_MARKER)}
    if spelt:
        raise ValueError(f"{pieces_path} has pieces that go on after white space")
    return Remembered(partial(_encode_bytes, bytes_path)), Remembered(partial(_encode_pieces, pieces_path))


class TokenPair:
    """Ids of whole texts by two tokenizers, each as of a space and the text."""

    def __init__(self, bytes_path: str, pieces_path: str) -> None:
        self.a, self.b = _pair(bytes_path, pieces_path)

    def of(self, rows: Iterable[tuple[Any, bytes]]) -> Iterator[tuple[Any, np.ndarray, np.ndarray, bool]]:
        """(key, a, b, last) for each segment of each text; both are empty where a
        segment's tokens do not spell it, or the text is empty."""
        block: list[tuple[Any, list[bytes], bool]] = []
        held = 0
        for key, raw in rows:
            if not raw or _MARKER.encode() in raw:  # The marker is read back as a space.
                block.append((key, [], True))
                continue
            left, first = len(raw), True
            for part in segments(raw, _CUT):
                left -= len(part)
                text = part if first else part[1:]
                block.append((key, _CUT.split(text) if _UNEVEN.search(text) else text.split(b" "), not left))
                held, first = held + len(part), False
                if held >= BLOCK:
                    yield from self._look_up(block)
                    block, held = [], 0
        yield from self._look_up(block)

    def _look_up(self, block: list[tuple[Any, list[bytes], bool]]) -> Iterator[tuple[Any, np.ndarray, np.ndarray, bool]]:
        chunks = [x for _, some, _ in block for x in some]
        a, b, at = self.a.packed(chunks), self.b.packed(chunks), 0
        for key, some, last in block:
            to = at + len(some)
            yield key, np.frombuffer(b"".join(a[at:to]), "<u4"), np.frombuffer(b"".join(b[at:to]), "<u4"), last
            at = to
