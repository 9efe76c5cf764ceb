"""Ids of texts by way of a bounded cache of units, for byte-level vocabularies whose pre-tokens begin at a space.

Under the pattern of those vocabularies no match goes past a single space between two characters that are no
white space: the match before it ends there and the next one starts with it. A text may be cut at such places
and its units encoded one by one; the ids are those of the whole text.
"""

from __future__ import annotations

import re

#: A space with other white space beside it.
BESIDE = re.compile(r" (?:(?<=\s )|(?=\s))")


def units_of(text: str) -> list[str]:
    """Cut ``text`` at the safe spaces. Every unit but the first stands for itself with a space before it."""
    parts = text.split(" ")
    if parts[0] and parts[-1] and not BESIDE.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        last = out[-1]
        if p and last and not p[0].isspace() and not last[-1].isspace():
            out.append(p)
        else:
            out[-1] = f"{last} {p}"
    return out


class _Known(dict):
    """Ids of units; a unit that isn't known yet is noted and gives None. Units not met since the last change of
    generation are in ``older``."""

    def __init__(self):
        super().__init__()
        self.new: dict[str, None] = {}
        self.older: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes | None:
        found = self.older.get(unit)
        if found is None:
            self.new[unit] = None
        else:
            self[unit] = found
        return found

    def turn(self) -> None:
        """What is known becomes the older generation; the one before it is forgotten."""
        self.older = dict(self)
        self.clear()


class UnitCache:
    """Little-endian 32-bit ids of units. ``encode_many`` gives them for units that aren't known yet.

    No more than about ``cap`` units are held, in two generations; those met again stay.
    """

    def __init__(self, encode_many, cap: int = 500_000):
        self.encode_many, self.cap, self.known = encode_many, cap, _Known()

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [units_of(t) for t in texts]
        known = self.known
        first = self.encode_many([units[0] for units in split])
        found = []
        for units in split:
            found.append([b"", *map(known.__getitem__, units[1:])])
        if new := list(known.new):
            known.new.clear()
            known.update(zip(new, self.encode_many([f" {u}" for u in new]), strict=True))
        out = []
        for head, ids, units in zip(first, found, split, strict=True):
            ids[0], at = head, 0
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                ids[at] = known[units[at]]
            out.append(b"".join(ids))
        if len(known) > self.cap // 2:
            known.turn()
        return out


def slices(texts: list[str], chars: int = 2_000_000):
    """(start, stop) of runs of texts with about so many characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
