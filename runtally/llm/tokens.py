"""Byte-level tokenizers in Spark tasks: cuts at which pieces of a text can be encoded apart, and a bounded memo of pieces."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Pieces longer than this are encoded each time; shorter ones are remembered.
LONG = 48
#: Pieces remembered by one Python worker before it starts anew.
MEMO = 600_000
#: Signs at the end of a word that the split pattern always parts from its letters, as one run.
SIGNS = ".,;:!?"

_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")


def cuts(text: str) -> list[str]:
    """A text cut at every space that a non-space follows, without those spaces.

    The split pattern of byte-level BPE takes a single space together with the run behind it and never looks back, so what
    lies between two such cuts, with its space put back, can be encoded alone.
    """
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Memo(dict):
    """Encodings of pieces, each with the space before it; pieces not yet known are encoded many at a time."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        super().__init__()
        self.encode = encode
        self.signs: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Encode pieces; letters that signs follow are encoded without them, as many words differ in those only."""
        stems = [x.rstrip(SIGNS) for x in new]
        alone = list({s if s != x and s.isalpha() else x for x, s in zip(new, stems)}.difference(self))
        self.update(zip(alone, self.encode([" " + x for x in alone])))
        for x, s in zip(new, stems):
            if x not in self:
                end = x[len(s):]
                if end not in self.signs:
                    if len(self.signs) >= MEMO:
                        self.signs.clear()
                    self.signs[end] = self.encode([end])[0]
                self[x] = self[s] + self.signs[end]

    def texts(self, texts: list[str]) -> list[bytes]:
        """The encodings of whole texts: those of their pieces, one after the other."""
        parts = [cuts(t) for t in texts]
        heads = self.encode([p[0] for p in parts])
        new = list(set().union(*(p[1:] for p in parts)).difference(self))
        self._learn(new)
        out = [b"".join([head, *map(self.__getitem__, p[1:])]) for head, p in zip(heads, parts)]
        if len(self) > MEMO:
            self.clear()
        else:
            for x in new:
                if len(x) > LONG:
                    del self[x]
        return out
