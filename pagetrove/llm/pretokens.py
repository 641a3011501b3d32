"""Token ids of whole texts through caches of the pieces between spaces.

The split pattern of byte-level BPE never matches across the border between a character that
is no white space and a following space. So a text is cut before each such space, and a
piece's ids are those of its matches. A text where a cut would fall inside a run of white
space is matched as a whole. The caches are bounded; they change speed, never ids.
"""

from array import array
from collections.abc import Callable

import regex

CACHE_ENTRIES = 500_000
MARKS = frozenset(".,;:!?")

EncodeTokens = Callable[[list[str]], list[list[int]]]


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit numbers; ``encode_tokens`` does the merges."""

    def __init__(self, pattern: str, encode_tokens: EncodeTokens):
        self.matches = regex.compile(pattern).findall
        self.open_end = regex.compile(r"^\s|\s$|^$").search
        self.encode_tokens = encode_tokens
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        self.tokens: dict[str, bytes] = {}

    def _learn(self, tokens: set[str]) -> None:
        new = list(tokens.difference(self.tokens))
        for token, ids in zip(new, self.encode_tokens(new)):
            self.tokens[token] = array("I", ids).tobytes()

    def _cut(self, piece: str, lead: str) -> list[str] | None:
        """Matches of one piece; None if its ends are not where a text may be cut."""
        if piece.isalpha():
            return [lead + piece]
        if piece[-1:] in MARKS and piece[:-1].isalpha():
            return [lead + piece[:-1], piece[-1]]
        return None if self.open_end(piece) else self.matches(lead + piece)

    def _fill(self, known: dict[str, bytes | None], pieces: set[str], lead: str) -> None:
        cut = {p: self._cut(p, lead) for p in pieces.difference(known)}
        self._learn({t for tokens in cut.values() if tokens for t in tokens})
        ids = self.tokens.__getitem__
        for piece, tokens in cut.items():
            known[piece] = None if tokens is None else b"".join(map(ids, tokens))

    def _whole(self, text: str) -> bytes:
        tokens = self.matches(text)
        self._learn(set(tokens))
        return b"".join(map(self.tokens.__getitem__, tokens))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        for cache in (self.first, self.later, self.tokens):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        cut = [text.split(" ") for text in texts]
        self._fill(self.first, {pieces[0] for pieces in cut}, "")
        self._fill(self.later, {p for pieces in cut for p in pieces[1:]}, " ")
        out = []
        later = self.later.__getitem__
        for text, pieces in zip(texts, cut):
            parts = [self.first[pieces[0]], *map(later, pieces[1:])]
            out.append(self._whole(text) if None in parts else b"".join(parts))
        return out
