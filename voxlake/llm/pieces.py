"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped (spaces become U+2581, one is put in front) and cut where such a mark
follows another character: no piece of the vocabulary holds a mark after another character, so
no merge crosses a cut. Inside a unit an agenda holds the adjacent symbol pairs whose joined
text is a piece, best score first, leftmost on ties; the best pair is merged, its new
neighbours enter the agenda, and pairs whose symbols have changed are passed over. Characters
without a piece become byte pieces.

Distinct units go through the agenda once, short ones many at a time. Each result is compared with
the sentencepiece library in the Arrow batch that brought the unit, those that begin or end with a
mark within their whole text; a difference raises.
Decoding is the library's ``decode(ids)``. Null texts are empty ones and have no ids. Repeated
rows and extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlake.llm.common import whole, worker_state
from voxlake.llm.units import UnitMemo, text_groups

MARK = "▁"
NEVER = 1 << 40
# row widths of units that are encoded together; longer ones have an agenda of their own
ROWS = (1, 7, 10, 13, 17, 25, 41)
#: odd units whose comparison a worker remembers
ODD_UNITS = 100_000

ENCODED = "STRUCT<ids: ARRAY<INT>, decoded: STRING>"


class PieceEncoder:
    """Agenda encoder over the pieces of a model whose normaliser keeps texts as they are."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        count = self.library.get_piece_size()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for k in range(count):
            piece = self.library.id_to_piece(k)
            if self.library.is_unused(k):
                raise ValueError("models with unused pieces are not supported")
            if self.library.is_byte(k):
                self.bytes[int(piece[1:-1], 16)] = k
            elif not self.library.is_control(k) and not self.library.is_unknown(k):
                self.ids[piece] = k
                self.score[piece] = self.library.get_score(k)
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} holds a mark inside")
        self.unknown = self.library.unk_id()
        self.compile()
        self.memo = UnitMemo(self.encode_units)
        self.compared: set[str] = set()

    def agenda(self, unit: str) -> list[int]:
        symbols: list[str | None] = list(unit)
        last = len(symbols) - 1
        left, right = list(range(-1, last)), list(range(1, last + 2))
        score, heap = self.score.get, []
        for i in range(last):
            joined = unit[i : i + 2]
            if (s := score(joined)) is not None:
                heappush(heap, (-s, i, i + 1, joined))
        while heap:
            _, i, j, joined = heappop(heap)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or right[i] != j or len(a) + len(b) != len(joined):
                continue
            symbols[i], symbols[j] = joined, None
            after = right[i] = right[j]
            before = left[i]
            if after <= last:
                left[after] = i
                longer = joined + symbols[after]
                if (s := score(longer)) is not None:
                    heappush(heap, (-s, i, after, longer))
            if before >= 0:
                longer = symbols[before] + joined
                if (s := score(longer)) is not None:
                    heappush(heap, (-s, before, i, longer))
        out: list[int] = []
        for symbol in symbols:
            if symbol is None:
                continue
            if (k := self.ids.get(symbol)) is not None:
                out.append(k)
            elif self.bytes:
                out += (self.bytes[b] for b in symbol.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def compile(self) -> None:
        """Symbols as numbers, and for each pair of symbols its merged symbol and its place in
        the order of scores; equal scores have equal places."""
        chars = sorted({c for piece in self.ids for c in piece})
        number = dict(self.ids)
        for c in chars:  # single characters without a piece of their own can still be merged
            number.setdefault(c, -1)
        dense = {s: k + 1 for k, s in enumerate(number)}  # 0: a character that never merges
        self.id_of = np.array([-1, *(self.ids.get(s, -1) for s in number)], np.int32)
        self.symbol = np.zeros(0x110000, np.int32)
        for c in chars:
            self.symbol[ord(c)] = dense[c]
        places = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        rows = sorted(
            (dense[p[:k]] << 32 | dense[p[k:]], dense[p], places[self.score[p]])
            for p in self.ids
            for k in range(1, len(p))
            if p[:k] in dense and p[k:] in dense
        )
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.keys, self.merged, self.place = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2]

    def priorities(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the agenda (``NEVER``: not a piece) and merged symbol of pairs of symbols."""
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.place[at], NEVER), np.where(hit, self.merged[at], 0)

    def agenda_rows(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agenda of many short units at once, a row each: every round takes the best pair of
        each row, leftmost on ties, merges it and enters the pairs with the new symbol."""
        rows, width = symbols.shape
        done, lengths = symbols.copy(), sizes.copy()
        place, merged = self.priorities(symbols[:, :-1], symbols[:, 1:])
        live = np.arange(rows)
        columns = np.arange(width)
        while len(live):
            best = place.argmin(1)
            each = np.arange(len(live))
            more = place[each, best] < NEVER
            if not more.all():
                done[live[~more]], lengths[live[~more]] = symbols[~more], sizes[~more]
                live, symbols, sizes = live[more], symbols[more], sizes[more]
                place, merged, best = place[more], merged[more], best[more]
                each = np.arange(len(live))
                if not len(live):
                    break
            symbols[each, best] = merged[each, best]
            shift = np.minimum(columns + (columns > best[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, shift, 1)
            sizes -= 1
            symbols[each, sizes] = 0
            shift = shift[:, : width - 1]
            shift = np.minimum(shift, width - 2)
            place, merged = np.take_along_axis(place, shift, 1), np.take_along_axis(merged, shift, 1)
            place[:, -1] = NEVER  # the last cell is padding now
            for column in (best - 1, best):
                inside = (column >= 0) & (column < width - 1)
                r, c = each[inside], column[inside]
                place[r, c], merged[r, c] = self.priorities(symbols[r, c], symbols[r, c + 1])
        return done, lengths

    def encode_units(self, keys: list[str]) -> Iterator[bytes]:
        """Ids of units (given without their first mark), compared with the library."""
        found: dict[str, bytes] = {}
        for low, high in zip(ROWS, ROWS[1:]):
            part = [k for k in keys if low <= len(k) + 1 < high]
            if part:
                found.update(zip(part, self.encode_rows(part, high - 1), strict=True))
        for key in keys:
            if found.get(key) is None:
                found[key] = np.array(self.agenda(MARK + key), np.int32).tobytes()
        self.compare(keys, found)
        return (found[k] for k in keys)

    def encode_rows(self, keys: list[str], width: int) -> Iterator[bytes | None]:
        """Ids of units of at most ``width`` characters; none where a character has no piece."""
        sizes = np.array([len(k) + 1 for k in keys])
        codes = np.frombuffer("".join(MARK + k for k in keys).encode("utf-32-le"), np.uint32)
        symbols = np.zeros((len(keys), max(2, width)), np.int32)
        symbols[columns_of(sizes, symbols.shape[1])] = self.symbol[codes]
        symbols, sizes = self.agenda_rows(symbols, sizes)
        ids = self.id_of[symbols]
        whole_rows = (ids >= 0).sum(1) == sizes
        ids = np.ascontiguousarray(ids)
        data, step = ids.tobytes(), ids.shape[1] * 4
        for k, (size, good) in enumerate(zip((sizes * 4).tolist(), whole_rows.tolist(), strict=True)):
            yield data[k * step : k * step + size] if good else None

    def compare(self, keys: list[str], found: dict[str, bytes]) -> None:
        """Compare the ids of units, one after the other as one text, with the library's."""
        keys = [k for k in keys if k and k[0] != MARK and k[-1] != MARK]
        for at in range(0, len(keys), 4_000):
            part = keys[at : at + 4_000]
            mine = np.frombuffer(b"".join(map(found.__getitem__, part)), np.int32)
            if not np.array_equal(mine, self.library.encode(MARK.join(part), num_threads=1)):
                for key in part:
                    a, b = np.frombuffer(found[key], np.int32).tolist(), self.library.encode(key)
                    if a != b:
                        raise ValueError(f"agenda and library differ on {key!r}: {a} and {b}")
                raise ValueError("agenda and library differ where units meet")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        keys = [unit_keys(t) if t else [] for t in texts]
        found = self.memo.lookup(keys)
        ids = [np.frombuffer(b"".join(values), np.int32) for values in found]
        self.compare_odd(texts, keys, ids)
        return ids

    def compare_odd(self, texts: list[str], keys: list[list[str]], ids: list[np.ndarray]) -> None:
        """Compare texts with units that ``compare`` cannot put beside others, each as a whole.

        These units begin or end with a mark, as texts with repeated, leading or trailing spaces
        make them. A text all of whose odd units were compared in earlier ones is left out.
        """
        if len(self.compared) > ODD_UNITS:
            self.compared.clear()
        for text, units, mine in zip(texts, keys, ids, strict=True):
            odd = {k for k in units if not k or k[0] == MARK or k[-1] == MARK}
            if not odd <= self.compared:
                if not np.array_equal(mine, self.library.encode(text, num_threads=1)):
                    raise ValueError(f"agenda and library differ on a text that begins {text[:60]!r}")
                self.compared |= odd

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def columns_of(sizes: np.ndarray, width: int) -> np.ndarray:
    """Mask of the filled cells of rows of given sizes."""
    return np.arange(width) < sizes[:, None]


def unit_keys(text: str) -> list[str]:
    """The units of a text with one mark in front, each without its own first mark."""
    text = text.replace(" ", MARK)
    keys = text.split(MARK)
    if MARK + MARK not in text and keys[0]:
        return keys
    out, marks = [], ""
    for key in keys[:-1]:
        if key:
            out.append(marks + key)
            marks = ""
        else:
            marks += MARK
    out.append(marks + keys[-1])
    return out


def encode_decode(text: Column, model: str) -> Column:
    """Struct column: ids of the whole text, and the text decoded from these ids.

    ``model`` is the path of a sentencepiece model of the merge type on every executor.
    """

    @F.arrow_udf(ENCODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_state("pieces", model, lambda: PieceEncoder(model))
        for batch in batches:
            ids: list[np.ndarray] = []
            decoded: list[str] = []
            for group in text_groups(batch.to_pylist()):
                part = encoder.encode(group)
                ids += part
                decoded += encoder.decode([x.tolist() for x in part])
            lengths = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            yield pa.StructArray.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)),
                    pa.array(decoded, pa.string()),
                ],
                ["ids", "decoded"],
            )

    return run(whole(text))
