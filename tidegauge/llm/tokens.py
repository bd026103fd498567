"""Token ids of whole texts, exactly those of the ``tokenizers`` library.

The pre-tokenizers of both vocabularies never put a token across a single space
or line end between two other characters, nor across the border of a letter and
a mark, so a text is the sequence of its pieces between such places. Each worker
remembers the ids of pieces it has met and asks the library for new ones: its
model where a piece is one word of letters that every Unicode version knows,
which spares normaliser and pre-tokenizer, else the whole library. Memory is
bounded: the pieces are forgotten when there are too many, which changes the
cost, never the ids.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches

#: Pieces a worker remembers, and the length of those worth remembering.
REMEMBERED = 1_200_000
LONGEST = 64
#: A space is a cut only between characters that are no white space.
INNER = re.compile(r"(?<=\S) (?=\S)")
RARE_SPACE = re.compile(r"[^\S \n]")
#: Both pre-tokenizers part a letter from such a mark, and keep a run of them together.
MARKS = ".,;:!?*#$%&|()\"-"
#: Letters below are the same in every Unicode version, composed, and (but for one) lower-cased to one letter.
LETTERS_END, TWO_LOWER = "\u0250", "\u0130"
OTHER_LETTERS = re.compile(f"[^\\x00-\u024f]|{TWO_LOWER}")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)}


BYTE_LETTERS = _byte_letters()


class _Pieces(dict):
    """Ids of pieces, found when first asked for."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find, self.before = find, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece) or self.find(piece)
        if len(piece) <= LONGEST:
            self[piece] = found
        return found

    def age(self) -> None:
        """Forgets what was not asked for since the last time."""
        self.before = dict(self)
        self.clear()


class Encoder:
    """``encode`` gives a text's ids as bytes (unsigned 32-bit, little-endian).

    ``spaced``: the vocabulary is byte-level and keeps a space with the word
    after it; otherwise white space is dropped. Texts of special tokens are
    ordinary text. Lone surrogates become the replacement character.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task: Spark has the cores
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.spaced = spaced
        self.line, self.lead = self._whole("\n"), BYTE_LETTERS[32] if spaced else ""
        self.known = _Pieces(lambda piece: self._ids(piece, self.known, self.lead))
        self.heads = _Pieces(lambda piece: self._ids(piece, self.heads, ""))  # pieces without a space before them
        self.marks = _Pieces(self._whole)

    def _whole(self, text: str) -> bytes:
        return _raw(self.library.encode(text, add_special_tokens=False).ids)

    def _ids(self, piece: str, known: _Pieces, lead: str) -> bytes:
        """Ids of a piece from those of its lines, of its word and the marks behind it, or from the library."""
        if piece.isalpha() and (piece.isascii() or max(piece) < LETTERS_END and TWO_LOWER not in piece):
            word = piece if self.spaced else piece.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
            return array("I", [t.id for t in self.model.tokenize(lead + word)]).tobytes()
        if "\n" in piece:
            lines = piece.split("\n")
            if all(lines) and not any(x[0].isspace() or x[-1].isspace() for x in lines):
                return known[lines[0]] + b"".join([self.line + self.heads[x] for x in lines[1:]])
        core = piece.rstrip(MARKS)
        if core != piece and core and core[-1].lower()[-1].isalpha():
            return known[core] + self.marks[piece[len(core):]]
        return self._whole(" " + piece if lead else piece)

    def pieces(self, text: str) -> list[str]:
        """Joined with a space they are the text (without ``spaced``: but for white space)."""
        if not self.spaced:
            if text.isascii() or not OTHER_LETTERS.search(text):
                text = text.lower()  # as the vocabulary's normaliser does: a word and its capital are learned once
            return text.replace("\n", " ").split(" ")
        uneven = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or RARE_SPACE.search(text)
        return INNER.split(text) if uneven else text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known, out = self.known.__getitem__, []
        for text in texts:
            pieces = self.pieces(_plain(text))
            head = self.heads[pieces.pop(0)] if self.spaced else b""
            out.append(head + b"".join(map(known, pieces)))
        if len(self.known) + len(self.heads) + len(self.marks) > REMEMBERED // 2:
            for pieces in (self.known, self.heads, self.marks):
                pieces.age()
        return out


def _raw(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _plain(text: str | None) -> str:
    return text.encode("utf-8", "replace").decode() if text and not text.isascii() and _lone(text) else text or ""


def _lone(text: str) -> bool:
    return re.search("[\ud800-\udfff]", text) is not None


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One per worker process, kept between tasks."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


#: Texts of one batch are encoded in groups of about so many characters.
GROUP_CHARS = 1_000_000


def groups(texts: list[str | None]) -> list[list[str | None]]:
    out, size = [[]], 0
    for text in texts:
        if size > GROUP_CHARS:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text or "")
    return out


def with_ids(docs: DataFrame, path: str, spaced: bool, end_id: int, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """``doc_id`` and ``ids`` of the whole text with the end id appended (NULL text: the end id alone)."""
    end = np.asarray([end_id], "<u4").tobytes()

    def make():
        coder = encoder(path, spaced)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [raw + end for group in groups(batch.column(1).to_pylist()) for raw in coder.encode(group)]
            return pa.RecordBatch.from_arrays([batch.column(0), id_lists(found)], ["doc_id", "ids"])
        return one
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, make)


def id_lists(found: list[bytes]) -> pa.Array:
    """Arrow lists of 32-bit ids from their bytes, without a Python object per id."""
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(raw) // 4 for raw in found], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(found))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
