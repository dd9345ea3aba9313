"""Distinct-chunk tables: each distinct chunk of text is encoded once and its ids joined back by position.

A tokenizer that never makes a token across a boundary gives a text the ids of its
chunks, one after the other. Two kinds of boundary are used:

* byte-level BPE: the place before one space that stands between two characters which
  are not white space. The pre-tokenizer starts a token at that space, and nothing before
  it looks further than the space.
* SentencePiece: the place before a run of whitespace markers, if no piece of the
  vocabulary has a marker after another character. That is checked when a model is loaded.

Tables live in the Python worker, are bounded by ``LIMIT`` entries in two generations
(entries in use survive a change of generation) and are never shared or sent anywhere.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

#: Entries of each of the two generations of a table.
LIMIT = 250_000
#: Longer chunks are encoded where they stand and not kept.
LONGEST = 80

_PAIR = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_MARKED = re.compile("[ ▁]+[^ ▁]*")

Encode = Callable[[list[str]], Iterable]


class ChunkTable:
    """chunk -> what encode() gives for it."""

    def __init__(self, encode: Encode, limit: int = LIMIT) -> None:
        self.encode, self.limit = encode, limit
        self.young: dict = {}
        self.old: dict = {}

    def fill(self, chunks: Iterable[list[str]]) -> dict:
        """A mapping that has every chunk of the lists; valid until the next call."""
        need = set().union(*chunks)
        if len(self.young) + len(need) > self.limit:
            self.old, self.young = self.young, {}
        need.difference_update(self.young)
        if self.old:
            kept = need & self.old.keys()
            self.young.update((x, self.old[x]) for x in kept)
            need -= kept
        new = list(need)
        self.young.update(zip(new, self.encode(new), strict=True))
        long = [x for x in new if len(x) > LONGEST]
        if not long:
            return self.young
        found = dict(self.young)
        for x in long:
            del self.young[x]
        return found


def space_chunks(text: str) -> tuple[str, list[str]]:
    """The first chunk as it stands and the others without the one space before each."""
    if _PAIR.search(text) or text[:1].isspace() or text[-1:].isspace():
        first, *rest = _SINGLE_SPACE.split(text)
    else:
        first, *rest = text.split(" ")
    return first, rest


def marked_chunks(text: str) -> list[str]:
    """Chunks of a nonempty text for SentencePiece, each without its first marker (the encoder puts one before)."""
    text = text.replace("▁", " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [x[1:] for x in _MARKED.findall(" " + text)]


def byte_tokenizer(path: str):
    """The tokenizers library on one core of its own; the cores of the machine belong to other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def piece_processor(path: str):
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for p in map(found.id_to_piece, range(found.get_piece_size())) if re.search("[^▁]▁", p)]
    if crossing:
        raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
    return found
