"""Token counts from finite-state machines compiled from a byte-level BPE file.

Two deterministic transducers give the count of a text without building its tokens.

* The *cutter* reads character classes and marks where the pre-tokenizer starts a token. It has
  twelve states, so a chunk of text is a map of twelve states to twelve; the maps of the
  chunks of all texts of a batch are composed by a parallel prefix scan, which gives the state
  in which each chunk begins, and a second pass over the chunks emits the marks.
* The *merger* reads the bytes of one such token. After each byte, the encoding of what has been
  read ends in one definite vocabulary entry. A state is what of that history can still matter:
  the positions from which some entry can still be completed, each with the entry that ends
  there and the count so far. A transition carries the change of the count, which may be
  negative when a merge takes earlier tokens back. States are compiled when first reached.

Which entry ends at a position follows from pairs: a sequence of entries is the encoding of its
bytes exactly if every two neighbours are the encoding of theirs.

Strings of added tokens inside a text count one each, as the tokenizers library has it by
default. Null texts are empty ones and count 0. Texts are cut at spaces first and the counts of
units are remembered, within a bound.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlake.llm.common import whole, worker_state
from voxlake.llm.units import LONG_UNIT, UnitMemo, cut_at_spaces, text_groups, unit_of

CHUNK = 64
# bounds on what a worker remembers; beyond them it starts over, with the same results
MERGER_STATES = 150_000
PAIRS = 300_000
TOKENS = 500_000
NONE = -1

# character classes; letters that can stand in a contraction have their own
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, STMD, RV, ELL, EE, PAD = range(11)
LETTERS = {LETTER, STMD, RV, ELL, EE}
# states: nothing open; open runs; white space of one or more characters, by its last one;
# quote; quote and r, v or l; contraction
START, WORD, DIGITS, MARKS, ONE_SPACE, ONE_BLANK, SPACES, BLANKS, QUOTED, QUOTED_RV, QUOTED_L, DONE = range(12)
CUT_HERE, CUT_BEFORE = 1, 2


def _fresh(cls: int) -> int:
    if cls in LETTERS:
        return WORD
    return {SPACE: ONE_SPACE, BLANK: ONE_BLANK, NUMBER: DIGITS, OTHER: MARKS, QUOTE: QUOTED}[cls]


def _after_space(cls: int) -> int:
    return WORD if cls in LETTERS else DIGITS if cls == NUMBER else MARKS


def _cutter_step(state: int, cls: int) -> tuple[int, int]:
    """Next state, and marks: a token starts at this character, or at the one before it."""
    if cls == PAD:
        return state, 0
    white = cls in (SPACE, BLANK)
    if state in (QUOTED_RV, QUOTED_L):
        if cls == (EE if state == QUOTED_RV else ELL):
            return DONE, 0
        # the letter after the quote began a word after all
        follow, marks = _cutter_step(WORD, cls)
        return follow, marks | CUT_BEFORE
    if state == QUOTED:
        if cls == STMD:
            return DONE, 0
        if cls == RV:
            return QUOTED_RV, 0
        if cls == ELL:
            return QUOTED_L, 0
        if cls in (OTHER, QUOTE):
            return MARKS, 0
    if state == WORD and cls in LETTERS:
        return WORD, 0
    if state == DIGITS and cls == NUMBER:
        return DIGITS, 0
    if state == MARKS and cls in (OTHER, QUOTE):
        return MARKS, 0
    if state in (ONE_SPACE, ONE_BLANK, SPACES, BLANKS):
        if white:
            return (SPACES if cls == SPACE else BLANKS), 0
        if state == ONE_SPACE:
            return _after_space(cls), 0
        if state == SPACES:
            return _after_space(cls), CUT_BEFORE
        if state == BLANKS:
            return _fresh(cls), CUT_BEFORE | CUT_HERE
    return _fresh(cls), CUT_HERE


def _classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    for lo, hi in ((9, 13), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                   (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[lo : hi + 1] = BLANK
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    for chars, cls in (("stmd", STMD), ("rv", RV), ("l", ELL), ("e", EE)):
        for c in chars:
            table[ord(c)] = cls
    return table


class Cutter:
    def __init__(self) -> None:
        self.classes = _classes()
        steps = [[_cutter_step(s, c) for c in range(PAD + 1)] for s in range(12)]
        self.next = np.array([[x[0] for x in row] for row in steps], np.uint8)
        self.marks = np.array([[x[1] for x in row] for row in steps], np.uint8)

    def cuts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the positions at which its pre-tokens start."""
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        chunks = np.maximum(1, -(-sizes // CHUNK))
        first = np.concatenate([[0], np.cumsum(chunks)])
        owner = np.repeat(np.arange(len(texts)), chunks)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        # position of every character in the padded grid of chunks
        place = np.arange(len(codes)) + np.repeat(first[:-1] * CHUNK - begins[:-1], sizes)
        grid = np.full(first[-1] * CHUNK, PAD, np.uint8)
        grid[place] = self.classes[codes]
        grid = grid.reshape(-1, CHUNK)
        width = min(CHUNK, int(sizes.max(initial=0)))
        state = self.starts(grid, width, first, owner, chunks)
        marks = np.zeros(grid.shape, np.uint8)
        for k in range(width):
            marks[:, k] = self.marks[state, grid[:, k]]
            state = self.next[state, grid[:, k]]
        flat = marks.reshape(-1)[place]
        cut = (flat & CUT_HERE).astype(bool)
        # marks for the character before, also where a text ends after a quote and r, v or l
        cut[:-1] |= (flat[1:] & CUT_BEFORE).astype(bool)
        ends = state[first[1:] - 1]
        open_quote = np.flatnonzero((ends == QUOTED_RV) | (ends == QUOTED_L))
        cut[begins[open_quote + 1] - 1] = True
        at = np.flatnonzero(cut)
        bounds = np.searchsorted(at, begins)
        return [at[bounds[k] : bounds[k + 1]] - begins[k] for k in range(len(texts))]

    def starts(self, grid, width, first, owner, chunks) -> np.ndarray:
        """The state in which each chunk begins."""
        begin = np.full(len(grid), START, np.uint8)
        if int(chunks.max(initial=1)) == 1:
            return begin
        maps = np.tile(np.arange(12, dtype=np.uint8), (len(grid), 1))
        for k in range(width):
            maps = self.next[maps, grid[:, k : k + 1]]
        maps[first[:-1]] = maps[first[:-1], START : START + 1]  # a text begins in START
        position = np.arange(len(grid)) - first[owner]
        reach = 1
        while reach < int(chunks.max()):  # after each round, maps cover twice as many chunks
            later = np.flatnonzero(position >= reach)
            maps[later] = np.take_along_axis(maps[later], maps[later - reach].astype(np.intp), 1)
            reach *= 2
        inner = np.flatnonzero(position > 0)
        begin[inner] = maps[inner - 1, START]
        return begin


class Merger:
    """The transducer over bytes that carries changes of the token count.

    A state is a tuple of open positions, oldest first: the node of the entry tree that the
    bytes since that position lead to, the entry that ends at the position (``NONE`` at the
    start) and the count there, relative to the count now.
    """

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.parts: dict[int, tuple[int, int, int]] = {}  # entry -> rank, left, right
        self.rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, joined = vocab[a], vocab[b], vocab[a + b]
            if joined in self.parts or any(
                len(x) > 1 and (y not in self.parts) for x, y in ((a, left), (b, right))
            ):
                raise ValueError("entries must come from one merge each, of earlier entries")
            self.parts[joined] = (rank, left, right)
            self.rank[left, right] = rank
        self.child: dict[int, int] = {}  # node << 8 | byte -> node; the root is 0
        self.entry = [NONE]  # entry that a node completes
        self.grows = [True]  # whether longer entries begin like this
        for text, entry in vocab.items():
            node = 0
            for byte in text:
                self.grows[node] = True
                after = self.child.get(node << 8 | byte)
                if after is None:
                    after = self.child[node << 8 | byte] = len(self.entry)
                    self.entry.append(NONE)
                    self.grows.append(False)
                node = after
            self.entry[node] = entry
        self.edges: dict[tuple[int, int], list] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.state: list[tuple] = [((0, NONE, 0),)]
        self.number: dict[tuple, int] = {self.state[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.known: dict[str, int] = {}

    def edge(self, entry: int, side: int) -> list[tuple[int, float]]:
        """Entries that stand at one edge while ``entry`` is built, each with the rank that ends it."""
        out = self.edges.get((entry, side))
        if out is None:
            out, ends, at = [(entry, float("inf"))], float("inf"), entry
            while at in self.parts:
                ends, at = self.parts[at][0], self.parts[at][side]
                out.append((at, ends))
            self.edges[entry, side] = out
        return out

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of ``a`` and ``b`` is ``a``, ``b``.

        It is not if some entry at the right edge of ``a`` would have merged with one at the
        left edge of ``b`` before either was used up; of equal ranks the left pair goes first.
        """
        known = self.pairs.get((a, b))
        if known is None:
            known, rank_of = True, self.rank.get
            for x, x_ends in self.edge(a, 2):
                for y, y_ends in self.edge(b, 1):
                    rank = rank_of((x, y))
                    if rank is not None and rank < x_ends and rank <= y_ends:
                        known = False
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def compile(self, number: int, byte: int) -> tuple[int, int]:
        child, open_now, last, change = self.child.get, [], NONE, 0
        for node, before, count in self.state[number]:
            node = child(node << 8 | byte)
            if node is None:
                continue
            # the longest entry that may follow what ends where it begins is the one
            if last == NONE and (entry := self.entry[node]) != NONE:
                if before == NONE or self.neighbours(before, entry):
                    last, change = entry, count + 1
            if self.grows[node]:
                open_now.append((node, before, count))
        if last == NONE:
            raise ValueError("no entry ends here")
        state = (*((n, b, c - change) for n, b, c in open_now), (0, last, 0))
        target = self.number.get(state)
        if target is None:
            target = self.number[state] = len(self.state)
            self.state.append(state)
        move = self.moves[number << 8 | byte] = (target, change)
        return move

    def count(self, token: str) -> int:
        known = self.known.get(token)
        if known is not None:
            return known
        if len(self.state) > MERGER_STATES or len(self.known) > TOKENS:
            self.reset()
        total = state = 0
        moves = self.moves
        for byte in token.encode("utf-8", "surrogatepass"):
            move = moves.get(state << 8 | byte)
            state, change = move if move is not None else self.compile(state, byte)
            total += change
        if len(token) <= LONG_UNIT:
            self.known[token] = total
        return total


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: the bytes themselves where
    they are printable in Latin-1, and code points from 256 on for the others, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenCounter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE"
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not spec["normalizer"]
            and not model.get("ignore_merges")
            and not model.get("dropout")
        )
        if not plain:
            raise ValueError("only plain byte-level BPE files are compiled")
        chars = _byte_chars()
        raw = {k: bytes(chars[c] for c in k) for k in model["vocab"] if all(c in chars for c in k)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens must be plain strings without white space")
        strings = [t["content"] for t in added]
        self.vocab = {raw[k]: v for k, v in model["vocab"].items() if k in raw and k not in strings}
        self.merger = Merger(self.vocab, [(raw[a], raw[b]) for a, b in pairs])
        self.cutter = Cutter()
        by_length = sorted(strings, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, by_length))) if strings else None
        self.memo = UnitMemo(self.count_units)

    def count_units(self, keys: list) -> list[int]:
        """Units that begin with one space and end without white space are counted one after
        the other as long texts, as a token starts at each such space; others alone."""
        joined, segments, owners, totals = [], [], [], np.zeros(len(keys), np.int64)
        for k, key in enumerate(keys):
            if self.added and self.added.search(unit := unit_of(key)):
                totals[k] = len(self.added.findall(unit))
                parts = [p for p in self.added.split(unit) if p]
            elif type(key) is str and key and not key[0].isspace() and not key[-1].isspace():
                joined.append(k)
                continue
            else:
                parts = [unit] if (unit := unit_of(key)) else []
            segments += parts
            owners += [np.array([0, k])] * len(parts)
        for at in range(0, len(joined), 4_000):
            part = joined[at : at + 4_000]
            segments.append(" " + " ".join([keys[k] for k in part]))
            starts = np.cumsum([0, *(len(keys[k]) + 1 for k in part)])
            owners.append(np.stack([starts[:-1], part], 1))
        count = self.merger.count
        for text, cuts, owner in zip(segments, self.cutter.cuts(segments), owners, strict=True):
            at = cuts.tolist()
            counts = [count(text[a:b]) for a, b in zip(at, [*at[1:], len(text)], strict=True)]
            if owner.ndim == 1:
                totals[owner[1]] += sum(counts)
            else:
                whose = owner[np.searchsorted(owner[:, 0], cuts, "right") - 1, 1]
                np.add.at(totals, whose, counts)
        return totals.tolist()

    def count(self, texts: list[str]) -> list[int]:
        return [sum(v) for v in self.memo.lookup([cut_at_spaces(t) if t else [] for t in texts])]


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of the whole text; ``tokenizer`` is the path of a byte-level BPE file."""

    @F.arrow_udf("BIGINT")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = worker_state("token counter", tokenizer, lambda: TokenCounter(tokenizer))
        for batch in batches:
            counts: list[int] = []
            for group in text_groups(batch.to_pylist()):
                counts += counter.count(group)
            yield pa.array(counts, pa.int64())

    return run(whole(text))
