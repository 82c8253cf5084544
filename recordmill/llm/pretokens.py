"""Splitting text into pre-tokens, and a bounded memory of what was found for them."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain, islice

import public_tokenizers
import regex

SPLIT = regex.compile(public_tokenizers.PATTERN)


#: White space that would be cut otherwise if a text were cut before each space.
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: ASCII white space before a space.
BEFORE = tuple(f"{c} " for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")


@lru_cache(1)
def unsettled() -> tuple[re.Pattern, re.Pattern]:
    """Characters whose letter or number class depends on the Unicode version of a regex engine.

    Those are the ones the regex module calls letters or numbers and this Python's tables don't, or the other way.
    Texts with one of them go to the tokenizer's own library, whose engine decides. The first pattern finds any
    character from the lowest of them on, the second only them.
    """
    every = "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    new = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN"]
    new += [ord(c) for c in regex.findall(r"[^\p{L}\p{N}]", every) if unicodedata.category(c)[0] in "LN"]
    new.sort()
    ranges, start = [], None
    for a, b in zip(new, [*new[1:], None]):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(f"{chr(start)}-{chr(a)}")
            start = None
    if not ranges:
        return re.compile(r"(?!)"), re.compile(r"(?!)")
    return re.compile(f"[^\0-{chr(new[0] - 1)}]"), re.compile(f"[{''.join(ranges)}]")


def settled(text: str) -> bool:
    """False where engines may split this text differently."""
    if text.isascii():
        return True
    high, exact = unsettled()
    return not (high.search(text) and exact.search(text))


def apart(text: str) -> bool:
    """Whether the matches of a settled text are those of its chunks, cut before each space."""
    if text.isascii():
        return not text.endswith(" ") and not any(x in text for x in BEFORE) or not UNSAFE.search(text)
    return not UNSAFE.search(text)


class Remembered:
    """What was found for each key, in two generations: the older is dropped when the newer is full."""

    def __init__(self, most: int, longest: int = 64):
        self.half, self.longest = most // 2, longest
        self.new: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Those of the distinct keys that aren't known; known ones stay in the newer generation."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        out = keys - self.new.keys()
        if self.old:
            kept = out & self.old.keys()
            self.new.update(zip(kept, map(self.old.__getitem__, kept)))
            out -= kept
        return list(out)

    def forget_long(self, keys) -> None:
        for k in [k for k in keys if len(k) > self.longest] if max(map(len, keys), default=0) > self.longest else ():
            self.new.pop(k, None)


class Encoder:
    """Encodes texts by what is known of their chunks (cut before each space), and those of their pre-tokens.

    Subclasses say what a pre-token, or a text that is not settled, encodes to; values are joined by add().
    """

    def __init__(self, chunks: int, pieces: int):
        self.chunks, self.pieces = Remembered(chunks), Remembered(pieces)

    def encode_pieces(self, pieces: list[str]) -> list:
        raise NotImplementedError

    def encode_text(self, text: str):
        raise NotImplementedError

    def add(self, values):
        raise NotImplementedError

    def by_pieces(self, many: list[str]) -> list:
        """Each string's value from its matches."""
        split = [SPLIT.findall(t) for t in many]
        if rest := self.pieces.missing({p for ps in split for p in ps}):
            self.pieces.new.update(zip(rest, self.encode_pieces(rest)))
        known = self.pieces.new.__getitem__
        out = [known(ps[0]) if len(ps) == 1 else self.add(map(known, ps)) for ps in split]
        self.pieces.forget_long(rest)
        return out

    def encode_chunks(self, chunks: list[str]) -> list:
        """The value of each chunk, a space and what follows to the next."""
        return self.by_pieces(chunks)

    def encode_many(self, many: list[str]) -> list:
        """The value of each text; those that aren't settled go to encode_text()."""
        out: list = [None] * len(many)
        cut, whole = [], []
        for i, t in enumerate(many):
            if not settled(t):
                out[i] = self.encode_text(t)
            elif apart(t):
                cut.append(i)
            else:
                whole.append(i)
        for i, v in zip(whole, self.by_pieces([many[i] for i in whole])):
            out[i] = v
        split = [many[i].split(" ") for i in cut]
        heads = self.by_pieces([c[0] for c in split])
        rest = self.chunks.missing(set().union(*split))
        self.chunks.new.update(zip(rest, self.encode_chunks([" " + x for x in rest])))
        known = self.chunks.new.__getitem__
        for i, head, c in zip(cut, heads, split):
            out[i] = self.add(chain((head,), map(known, islice(c, 1, None))))
        self.chunks.forget_long(rest)
        return out
