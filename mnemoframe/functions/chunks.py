"""Text chunkers with exact boundary rules, as plain Python over one text.

Words are pieces that end behind a space or a sentence end with its spaces; the
pieces join to the text again.  Sentences, paragraphs and chunks are folds over
them, so a boundary depends on the ones before: they run per text inside an
Arrow batch (``mnemoframe.operators.chunking``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from mnemoframe.functions.fixed import SENTENCE_ENDS

_PIECE = re.compile(f"[^ {re.escape(SENTENCE_ENDS)}]*(?:[{re.escape(SENTENCE_ENDS)}] *| )|[^ {re.escape(SENTENCE_ENDS)}]+$")
Counter = Callable[[str], int]


def count_words(text: str) -> int:
    return len(text.split())


def words(text: str) -> Iterator[tuple[str, str]]:
    """Pieces with their type: ``word``, ``sentence_end`` or ``paragraph_end`` (a line break follows)."""
    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece.rstrip(" ")[-1:] in SENTENCE_ENDS and piece.strip(" "):
            yield piece, "paragraph_end" if text[m.end() : m.end() + 1] in ("\n", "\r") else "sentence_end"
        else:
            yield piece, "word"


def sentences(text: str, limit: int | None = None, count: Counter = count_words) -> Iterator[tuple[str, int, str]]:
    """``(sentence, size, cut type)``; a limit cuts a sentence before the word that would exceed it."""
    held, size, cut = "", 0, "word"
    opened = False
    for piece, kind in words(text):
        n = count(piece)
        if kind != "word" or any(c.isalpha() for c in piece):
            cut = kind
        if limit is not None and opened and size + n > limit:
            yield held, size, cut
            held, size = piece, n
            continue
        held, size, opened = held + piece, size + n, True
        if kind != "word":
            yield held, size, kind
            held, size, opened = "", 0, False
    if held:
        yield held, size, "sentence_cut" if cut == "word" else cut


def paragraphs(text: str, limit: int, batch: bool = True, count: Counter = count_words) -> Iterator[tuple[str, int, str]]:
    """``(text, size, cut type)`` of paragraphs packed up to the limit, or of each paragraph if not ``batch``."""
    held, size, last = "", 0, "word"
    for sentence, n, cut in sentences(text, limit, count):
        if size > 0 and size + n > limit:
            yield held, size, last
            held, size = "", 0
        held, size, last = held + sentence, size + n, cut
        if not batch and cut in ("paragraph_end", "sentence_cut"):
            yield held, size, cut
            held, size = "", 0
    if held:
        yield held, size, "sentence_cut" if last == "word" else last


def text_chunks(document: str, text: str, limit: int, count: Counter = count_words) -> Iterator[tuple[str, int, str, int, str]]:
    """``(chunk, size, cut type, index, id)``: paragraphs of a document, packed up to the limit."""
    for index, (chunk, size, cut) in enumerate(paragraphs(text, limit, True, count)):
        key = chunk if size > limit else f"{document}-{index}"
        yield chunk, size, cut, index, str(uuid.uuid5(uuid.NAMESPACE_OID, key))


def row_chunks(document: str, text: str, limit: int, count: Counter = count_words) -> Iterator[tuple[str, int, str, int, str]]:
    """Rows split at blank lines and packed pair by pair (``name: value``), never across rows."""
    index = 0
    for row in text.split("\n\n"):
        if not row.strip():
            continue
        held: list[str] = []
        size = 0
        for pair in row.split(", "):
            n = count(pair)
            if held and size + n > limit:
                joined = ", ".join(held)
                yield joined, count(joined), "row_cut", index, str(uuid.uuid5(uuid.NAMESPACE_OID, f"{document}-{index}"))
                index, held, size = index + 1, [], 0
            held.append(pair)
            size += n
        joined = ", ".join(held)
        yield joined, count(joined), "row_end", index, str(uuid.uuid5(uuid.NAMESPACE_OID, f"{document}-{index}"))
        index += 1
