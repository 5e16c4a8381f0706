"""Removal of every byte inside a long string that occurs elsewhere too.

A byte of a text goes if it lies in a string of ``length`` bytes that starts at two or more
places of the corpus, in one text or several. Texts are UTF-8 bytes; strings never cross them.

1. Each window of ``length`` bytes is named by the smallest hashed ``GRAM``-byte string in it,
   leftmost on ties. Equal windows have equal names at equal offsets, so only windows with the
   same anchor string can be equal. The windows around one anchor are one *context*: the text
   from the first window's start to the last one's end.
2. Contexts of anchors that occur once are done. A context that occurs twice as a whole is
   repeated in all its windows. What is left are different contexts of one anchor: each is taken
   once, from one text, however many copies it has.
3. These are cut into blocks of ``BLOCK`` bytes counted from the anchor, so that equal windows
   have equal blocks. Blocks get numbers in their own order, and the suffix array of the
   contexts of many anchors, one after the other, is built over them by linear grouping.
   Neighbouring suffixes that agree in all whole blocks of a window form a class; in a class,
   windows are equal if the bytes before and after these blocks are.
4. An anchor with more than ``HOT`` different contexts is not taken into one task: its windows
   are counted by their hashes instead. The result is the same.
5. The removed ranges of a text are joined back to all rows with that text.

Null texts are empty ones. Repeated rows are copies of one another. Extra columns stay as they
are; a column with the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import kept, short_batches, unused, whole
from voxlake.llm.suffixes import suffix_array

LENGTH = 400
GRAM = 32
BLOCK = 16
HOT = 10_000
SYMBOLS = 120_000  # of one suffix array, about
CHUNK = 1 << 19  # windows of a text that are looked at together
_PLACE = np.uint64((1 << 20) - 1)
_PRIME = 0x100000001B3

RECORD = "a BIGINT, c BIGINT, t1 BIGINT, t2 BIGINT, lo BIGINT, n INT, before INT"
RANGE = "STRUCT<start: BIGINT, end: BIGINT>"


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text, 128 bits together."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("again"), text).alias("t2")]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h, reach = data.astype(np.uint64) + np.uint64(1), 1
    while reach < GRAM:
        h = h[:-reach] * np.uint64(pow(_PRIME, reach, 1 << 64)) + h[reach:]
        reach *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def contexts(data: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, start of the first window, windows, bytes before the anchor)."""
    for base in range(0, len(data) - length + 1, CHUNK):
        part = np.frombuffer(data, np.uint8)[base : base + CHUNK + length - 1]
        hashes = _gram_hashes(part)
        marked = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_lowest(marked, length - GRAM + 1) & _PLACE).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        sizes = np.diff(np.append(starts, len(anchor)))
        at = anchor[starts]
        yield from zip(
            hashes[at].view(np.int64).tolist(),
            (starts + base).tolist(),
            sizes.tolist(),
            (at - starts).tolist(),
            strict=True,
        )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def find_contexts(texts: DataFrame, length: int) -> DataFrame:
    """``texts`` (text, t1, t2) to a record for each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(x, pa.int64()) for x in ("a", "c", "t1", "t2", "lo")]
            + [("n", pa.int32()), ("before", pa.int32())]
        )
        for batch in batches:
            rows = []
            for text, t1, t2 in zip(
                *(batch.column(x).to_pylist() for x in ("text", "t1", "t2")), strict=True
            ):
                data = text.encode("utf-8", "surrogatepass")
                for a, lo, n, before in contexts(data, length):
                    c = _signed(xxhash.xxh3_64_intdigest(data[lo : lo + n - 1 + length]))
                    rows.append((a, c, t1, t2, lo, n, before))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays(list(zip(*rows, strict=True)), schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(list(zip(*rows, strict=True)), schema=schema)

    return texts.mapInArrow(run, RECORD)


class _Group:
    """Contexts to be compared in one suffix array."""

    def __init__(self, length: int) -> None:
        self.length, self.keys, self.data, self.before, self.windows = length, [], [], [], []
        self.symbols = 0

    def add(self, key: tuple[int, int], data: bytes, before: int, windows: int) -> None:
        self.keys.append(key)
        self.data.append(data)
        self.before.append(before)
        self.windows.append(windows)
        self.symbols += len(data) // BLOCK + 1

    def repeated(self) -> list[np.ndarray]:
        """For each context the windows that occur in another one."""
        inner = self.length // BLOCK - 1  # whole blocks in a window at any offset
        edge = self.length - inner * BLOCK  # bytes of a window outside these blocks
        count = len(self.data)
        before = np.array(self.before)
        lengths = np.array([len(d) for d in self.data])
        # every context is padded so that its anchor is at a block boundary and that the bytes
        # before and after the whole blocks of any window can be read
        front = -before % BLOCK + 2 * BLOCK
        rows = -(-(front + lengths) // BLOCK) + 3
        first = np.concatenate([[0], np.cumsum(rows)])
        buffer = np.zeros(first[-1] * BLOCK, np.uint8)
        for k, data in enumerate(self.data):
            at = first[k] * BLOCK + front[k]
            buffer[at : at + len(data)] = np.frombuffer(data, np.uint8)
        _, numbers = np.unique(_ordered(buffer), return_inverse=True)
        numbers = numbers.ravel() + 2
        numbers[first[1:] - 1] = 1  # contexts end in a symbol below all blocks
        order = np.array(suffix_array([*numbers.tolist(), 0])[1:])
        # suffixes whose whole blocks lie inside their context
        owner = np.repeat(np.arange(count), rows)
        inside_from = first[:-1] * BLOCK + front
        inside_to = inside_from + lengths
        starts = np.arange(first[-1]) * BLOCK
        good = (starts >= inside_from[owner]) & (starts + inner * BLOCK <= inside_to[owner])
        order = order[good[order]]
        if not len(order):
            return [np.empty(0, np.int64)] * count
        same = np.ones(len(order) - 1, bool)
        for k in range(inner):
            same &= numbers[order[1:] + k] == numbers[order[:-1] + k]
        cls = np.concatenate([[0], np.cumsum(~same)])
        many = np.bincount(cls)[cls] > 1
        order, cls = order[many], cls[many]
        found: list[list[np.ndarray]] = [[] for _ in range(count)]
        if len(order):
            head = buffer.reshape(-1, BLOCK)[order - 1]
            tail_at = (order + inner)[:, None] * BLOCK + np.arange(edge)
            tail = buffer[np.minimum(tail_at, len(buffer) - 1)]
            for take in range(BLOCK):  # bytes of the window before its whole blocks
                start = order * BLOCK - take
                whose = owner[order]
                fits = (start >= inside_from[whose]) & (start + self.length <= inside_to[whose])
                if not fits.any():
                    continue
                key = np.zeros((int(fits.sum()), 8 + BLOCK + edge), np.uint8)
                key[:, :8] = cls[fits].astype(np.int64).view(np.uint8).reshape(-1, 8)
                key[:, 8 : 8 + take] = head[fits][:, BLOCK - take :]
                key[:, 8 + BLOCK : 8 + BLOCK + edge - take] = tail[fits][:, : edge - take]
                _, which, times = np.unique(
                    key.view(f"V{key.shape[1]}").ravel(), return_inverse=True, return_counts=True
                )
                again = times[which.ravel()] > 1
                at, whose = start[fits][again], whose[fits][again]
                for k, w in zip(whose.tolist(), (at - inside_from[whose]).tolist(), strict=True):
                    found[k].append(w)
        return [
            np.array(sorted(w for w in f if w < self.windows[k]), np.int64)
            for k, f in enumerate(found)
        ]


def _ordered(buffer: np.ndarray) -> np.ndarray:
    """Blocks as pairs of big-endian numbers, so that their order is that of their bytes."""
    pairs = buffer.reshape(-1, BLOCK).copy().view(">u8").astype(np.uint64)
    out = np.empty(len(pairs), [("high", np.uint64), ("low", np.uint64)])
    out["high"], out["low"] = pairs[:, 0], pairs[:, 1]
    return out


def _runs(windows: np.ndarray) -> list[dict]:
    """First and last of each run of consecutive windows."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > 1)
    firsts = windows[np.concatenate([[0], cut + 1])]
    lasts = windows[np.concatenate([cut, [len(windows) - 1]])]
    return [{"first": a, "last": b} for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)]


RUNS = "a BIGINT, c BIGINT, runs ARRAY<STRUCT<first: INT, last: INT>>"
_RUN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def compare_contexts(found: DataFrame, length: int) -> DataFrame:
    """Different contexts of anchors (a, c, data, before, n) to their repeated windows.

    Rows come sorted by anchor; whole anchors are gathered until they fill a suffix array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchor = _Group(length), None

        def done(group: _Group) -> pa.RecordBatch:
            windows = group.repeated()
            return pa.RecordBatch.from_pydict(
                {
                    "a": pa.array([k[0] for k in group.keys], pa.int64()),
                    "c": pa.array([k[1] for k in group.keys], pa.int64()),
                    "runs": pa.array([_runs(w) for w in windows], _RUN),
                }
            )

        for batch in batches:
            for row in batch.to_pylist():
                if row["a"] != anchor and group.symbols > SYMBOLS:
                    yield done(group)
                    group = _Group(length)
                anchor = row["a"]
                group.add((anchor, row["c"]), row["data"], row["before"], row["n"])
        if group.keys:
            yield done(group)

    columns = found.select("a", "c", "data", "before", "n")
    dealt = columns.repartition("a").sortWithinPartitions("a", "c")
    return dealt.mapInArrow(run, RUNS)


def count_windows(found: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: every window is counted by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, hashes = row["data"], []
                for w in range(row["n"]):
                    hashes.append(_signed(xxhash.xxh3_64_intdigest(data[w : w + length])))
                yield pa.RecordBatch.from_pydict(
                    {
                        "a": pa.array([row["a"]] * len(hashes), pa.int64()),
                        "c": pa.array([row["c"]] * len(hashes), pa.int64()),
                        "w": pa.array(range(len(hashes)), pa.int32()),
                        "h": pa.array(hashes, pa.int64()),
                    }
                )

    windows = found.select("a", "c", "data", "n").mapInArrow(run, "a BIGINT, c BIGINT, w INT, h BIGINT")
    again = windows.groupBy("a", "h").count().where("count > 1").drop("count")
    repeated = windows.join(again, ["a", "h"], "left_semi")
    one = F.struct(F.col("w").alias("first"), F.col("w").alias("last"))
    return repeated.groupBy("a", "c").agg(F.collect_list(one).alias("runs"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs`` (text) to t1, t2 and ranges: the bytes to remove of each text that has some."""
    if length < 3 * GRAM or length % BLOCK:
        raise ValueError(f"length must be a multiple of {BLOCK} and {3 * GRAM} at least")
    short_batches(docs.sparkSession)
    text = whole(F.col("text"))
    texts = docs.select(text.alias("text"), *text_key(text))
    # copies of a text bring equal records: one is left, with their number, so that an anchor is
    # not hot for the copies of its text
    records = kept(
        find_contexts(texts, length)
        .groupBy("t1", "t2", "lo")
        .agg(
            *(F.first(x).alias(x) for x in ("a", "c", "n", "before")),
            F.count("*").alias("copies"),
        ),
        "contexts",
    )
    anchors = records.groupBy("a").agg(F.sum("copies").alias("places")).where("places > 1").select("a")
    shared = kept(records.join(anchors, "a", "left_semi"), "shared")
    place = F.struct("t1", "t2", "lo")
    different = kept(
        shared.groupBy("a", "c").agg(
            F.sum("copies").alias("copies"),
            F.min(place).alias("place"),
            F.first("n").alias("n"),
            F.first("before").alias("before"),
        ),
        "different",
    )
    sizes = different.groupBy("a").agg(F.count("*").alias("contexts")).where("contexts > 1")
    # one text of each context that has to be compared
    wanted = kept(
        different.join(sizes, "a").select("a", "c", "place.*", "n", "before", "contexts"), "wanted"
    )
    sources = docs.select(text.alias("text"), *text_key(text))
    places = wanted.groupBy("t1", "t2").agg(
        F.collect_list(F.struct("a", "c", "lo", "n", "before", "contexts")).alias("places")
    )
    cut = sources.join(places, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    found = kept(cut.select(F.inline(_cut(length)("text", "places"))), "context-bytes")
    runs = compare_contexts(found.where(F.col("contexts") <= hot), length).unionByName(
        count_windows(found.where(F.col("contexts") > hot), length)
    )
    every = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") - 1).alias("last")))
    whole_context = different.where("copies > 1").select("a", "c", every.alias("runs"))
    runs = kept(
        runs.join(whole_context, ["a", "c"], "left_anti").where(F.size("runs") > 0)
        .unionByName(whole_context),
        "runs",
    )
    ranges = shared.join(runs, ["a", "c"]).select("t1", "t2", "lo", F.explode("runs").alias("r"))
    one = F.struct(
        (F.col("lo") + F.col("r.first")).cast("bigint").alias("start"),
        (F.col("lo") + F.col("r.last") + length).cast("bigint").alias("end"),
    )
    # a text has no more ranges than windows
    return ranges.groupBy("t1", "t2").agg(F.collect_list(one).alias("ranges"))


def _cut(length: int):
    place = pa.struct(
        [("a", pa.int64()), ("c", pa.int64()), ("data", pa.binary()), ("before", pa.int32()),
         ("n", pa.int32()), ("contexts", pa.int64())]
    )

    @F.arrow_udf(
        "ARRAY<STRUCT<a: BIGINT, c: BIGINT, data: BINARY, before: INT, n: INT, contexts: BIGINT>>"
    )
    def run(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for text, wanted in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            out.append(
                [
                    {"a": p["a"], "c": p["c"], "before": p["before"], "n": p["n"],
                     "contexts": p["contexts"],
                     "data": data[p["lo"] : p["lo"] + p["n"] - 1 + length]}
                    for p in wanted
                ]
            )
        return pa.array(out, pa.list_(place))

    return run


def _kept_bytes():
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf(f"STRUCT<kept: BINARY, spans: ARRAY<{RANGE}>>")
    def run(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        kept_bytes, spans = [], []
        for text, removed in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for a, b in sorted((r["start"], r["end"]) for r in removed or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            parts, at = [], 0
            for a, b in merged:
                parts.append(data[at:a])
                at = b
            kept_bytes.append(b"".join([*parts, data[at:]]))
            spans.append([{"start": a, "end": b} for a, b in merged])
        return pa.StructArray.from_arrays(
            [pa.array(kept_bytes, pa.binary()), pa.array(spans, pa.list_(span))], ["kept", "spans"]
        )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, column: str = "repeats") -> DataFrame:
    """``docs`` with the struct ``column``: kept (bytes that are left) and spans (removed runs)."""
    k1, k2, r = unused(docs, "t1", "t2", "ranges")
    ranges = repeated_ranges(docs, length).toDF(k1, k2, r)
    text = whole(F.col("text"))
    key = text_key(text)
    rows = docs.withColumns({k1: key[0], k2: key[1]}).join(ranges, [k1, k2], "left")
    return rows.withColumn(column, _kept_bytes()(text, F.col(r))).drop(k1, k2, r)
