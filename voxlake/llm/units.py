"""Cutting texts into units that a tokenizer treats independently, with a bounded memo."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain

MEMO_UNITS = 350_000
LONG_UNIT = 48


_TOUCHING = re.compile(r"\s\s")


def cut_at_spaces(text: str) -> list:
    """Keys of the units of a text, cut before spaces that have no white space beside them.

    A byte-level pre-tokenizer starts a token at such a space whatever surrounds it, so
    units can be encoded one by one. A key is the unit without its first space; the unit
    that begins the text has no such space and its key is a tuple of itself.
    """
    pieces = text.split(" ")
    if _TOUCHING.search(text) is None:
        keys: list = pieces
    else:
        keys, before = [pieces[0]], pieces[0]
        for piece in pieces[1:]:
            if before and piece and not before[-1].isspace() and not piece[0].isspace():
                keys.append(piece)
            else:
                keys[-1] += " " + piece
            before = piece
    keys[0] = (keys[0],)
    return keys


def unit_of(key) -> str:
    """The text of the unit that a key of ``cut_at_spaces`` stands for."""
    return key[0] if type(key) is tuple else " " + key


class UnitMemo:
    """Values of units; unknown ones are computed together, once per batch of texts.

    Holds at most ``limit`` units of at most ``LONG_UNIT`` characters and starts over when
    full; longer units are computed each time. The result does not depend on either bound.
    """

    def __init__(self, compute: Callable[[list], Iterable], limit: int = MEMO_UNITS) -> None:
        self.compute = compute
        self.limit = limit
        self.known: dict = {}

    def lookup(self, batch: list[list]) -> list[list]:
        """For each list of units the list of their values."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        missing = list(set(chain.from_iterable(batch)).difference(known))
        known.update(zip(missing, self.compute(missing), strict=True))
        found = [list(map(known.__getitem__, units)) for units in batch]
        for unit in missing:
            if len(unit) > LONG_UNIT:
                del known[unit]
        return found


def text_groups(texts: list[str], chars: int = 1 << 20) -> Iterable[list[str]]:
    """Consecutive texts of about ``chars`` characters together; a longer text goes alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
