"""Byte-level BPE ids of whole texts, with the words already met remembered.

Words repeat: the ids of what stands between white space are kept a process, so
only new words reach the merges. The pattern that splits text before the merges
always splits before a lone space or newline between other characters, before
the first character after such a newline, and between letters and full stops or
commas, which is why these parts can be encoded one by one; a text with any other
white space is encoded as a whole.
"""

from __future__ import annotations

import base64
from array import array
from functools import cache

import tiktoken

#: The most parts whose ids a process remembers, twice: the last so many, and as many before them.
REMEMBERED = 120_000
#: The special token that a text may spell out, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
STOPS = ".,;:!?"


class _Parts(dict):
    """The ids of ``lead`` + part as little-endian unsigned 32-bit integers."""

    def __init__(self, own: tiktoken.Encoding, lead: str):
        super().__init__()
        self.own, self.lead, self.stops, self.before = own, lead, {}, {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        if (out := self.before.get(part)) is not None:
            self[part] = out
            return out
        bare = part.rstrip(STOPS)
        if bare and bare.isalpha():
            if bare != part:
                after = part[len(bare) :]
                if (tail := self.stops.get(after)) is None:
                    tail = self.stops[after] = array("I", self.own.encode_ordinary(after)).tobytes()
                out = self[bare] + tail
            else:
                out = array("I", self.own._encode_single_piece((self.lead + part).encode())).tobytes()
        else:
            out = array("I", self.own.encode_ordinary(self.lead + part)).tobytes()
        self[part] = out
        return out


@cache
def encoder(ranks_path: str, pattern: str) -> tuple[tiktoken.Encoding, _Parts, _Parts, bytes]:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    return own, _Parts(own, ""), _Parts(own, " "), array("I", own.encode_ordinary("\n")).tobytes()


def ids(text: str, ranks_path: str, pattern: str) -> bytes:
    """The ids of ``text`` as little-endian unsigned 32-bit integers; the special token's string counts as that token."""
    own, leading, spaced, newline = encoder(ranks_path, pattern)
    if SPECIAL in text:
        return array("I", own.encode(text, allowed_special={SPECIAL})).tobytes()
    if " ".join(text.split()) != text.replace("\n", " "):
        return array("I", own.encode_ordinary(text)).tobytes()
    lines = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        lines.append(leading[first] + b"".join(map(spaced.__getitem__, rest)) if first else b"")
    return newline.join(lines)
