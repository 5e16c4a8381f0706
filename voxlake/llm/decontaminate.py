"""Benchmark decontamination: test n-grams as a hash set beside every task.

Words are the maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A
window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one
window. A document word is hit when it lies in an occurrence of a window.

Words of items get numbers. A document becomes a sequence of such numbers (0: a word of no
item), rolling hashes of its windows are looked up in the sorted hashes of the test windows,
and hits are verified by comparing the numbers themselves. The items are broadcast in shards
of bounded size; each shard scans all documents and the hits of all shards are joined, so a
benchmark of any size works and one of usual size takes one scan.

Null or empty texts have no words and no hits. Repeated items count by id; items with a null
id hit words but are not named. Extra columns are kept by ``remove_spans``, ignored by ``scan``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import kept, short_batches, unused, worker_state

# characters of items in one broadcast shard (its tables take some twenty times as many bytes)
SHARD_CHARS = 8 << 20
_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SCAN_FIELDS = "n_words: BIGINT, hits: ARRAY<STRUCT<start: INT, end: INT>>, items: ARRAY<BIGINT>"
SCAN = f"STRUCT<{SCAN_FIELDS}>"


def words_of(data: bytes) -> list[bytes]:
    """UTF-8 words of a UTF-8 text."""
    return data.translate(_KEPT).split()


class Windows:
    """The windows of some items, by length: numbers of their words and items that hold them."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int) -> None:
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            words = [
                self.number.setdefault(w, len(self.number) + 1)
                for w in words_of((text or "").encode("utf-8", "surrogatepass"))
            ]
            size = min(n, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                held = by_length.setdefault(size, {}).setdefault(tuple(words[k : k + size]), set())
                if item is not None:
                    held.add(item)
        self.tables = []
        for size, windows in by_length.items():
            grams = np.array(list(windows), np.uint64).reshape(-1, size)
            keys = _rolled(grams.reshape(-1), size)[::size]
            order = np.argsort(keys, kind="stable")
            owners = [sorted(o) for o in windows.values()]
            self.tables.append((size, keys[order], grams[order], [owners[k] for k in order]))

    def hits(self, words: list[bytes], prior: list | None = None) -> tuple[np.ndarray, set]:
        """Starts and ends (exclusive) of the merged runs of hit words; ids of their items.

        ``prior`` are runs found by other shards.
        """
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        marks = np.zeros(len(words) + 1, np.int64)
        for run in prior or ():
            marks[run["start"]] += 1
            marks[run["end"]] -= 1
        items: set = set()
        known = ids > 0
        for size, keys, grams, owners in self.tables:
            if len(ids) < size:
                continue
            inside = np.concatenate([[0], np.cumsum(known)])
            at = np.flatnonzero(inside[size:] - inside[:-size] == size)
            if not len(at):
                continue
            rolled = _rolled(ids, size)[at]
            first = np.searchsorted(keys, rolled, "left")
            at, rolled, first = (x[first < len(keys)] for x in (at, rolled, first))
            same = keys[first] == rolled
            for start, k, key in zip(at[same], first[same], rolled[same], strict=True):
                while k < len(keys) and keys[k] == key:
                    if np.array_equal(grams[k], ids[start : start + size]):
                        marks[start] += 1
                        marks[start + size] -= 1
                        items.update(owners[k])
                    k += 1
        hit = np.concatenate([[False], np.cumsum(marks)[:-1] > 0, [False]])
        return np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2), items


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive numbers."""
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ ids[k : len(ids) - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shards(benchmark: DataFrame, limit: int = SHARD_CHARS) -> list[DataFrame]:
    """``benchmark`` dealt into as many parts as keep each near ``limit`` characters."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-chars // limit) if chars else 1
    if count == 1:
        return [benchmark]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    return [benchmark.where(part == k) for k in range(count)]


def _scanner(items: DataFrame, n: int, cut: bool = False):
    """Scan of texts for the windows of ``items``; with ``cut`` also the text without its hits."""
    rows = [(r.item_id, r.text) for r in items.select("item_id", "text").toLocalIterator()]
    shared = items.sparkSession.sparkContext.broadcast(rows)
    version = uuid.uuid4().hex
    run = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(f"STRUCT<{SCAN_FIELDS}, left: STRING>" if cut else SCAN)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        windows = worker_state("windows", version, lambda: Windows(shared.value, n))
        for texts, priors in batches:
            counts, spans, found, left = [], [], [], []
            for text, prior in zip(texts.to_pylist(), priors.to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                words = words_of(data)
                runs, items = windows.hits(words, prior["hits"] if prior else None)
                counts.append(len(words))
                spans.append([{"start": int(a), "end": int(b)} for a, b in runs])
                found.append(sorted(items.union(prior["items"] if prior else ())))
                if cut:
                    left.append(without_words(data, runs) if len(runs) else text)
            columns = [
                pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(run)),
                pa.array(found, pa.list_(pa.int64())),
            ]
            names = ["n_words", "hits", "items"]
            if cut:
                columns, names = [*columns, pa.array(left, pa.string())], [*names, "left"]
            yield pa.StructArray.from_arrays(columns, names)

    # else a filter on the result scans each text again, by a second worker beside each task's first
    return scan.asNondeterministic()


def without_words(data: bytes, runs) -> str:
    """A UTF-8 text without its runs of words, each from its first word to the end of its last."""
    words = [m.span() for m in _WORD.finditer(data.translate(_KEPT))]
    keep, at = [], 0
    for start, end in runs:
        keep.append(data[at : words[start][0]])
        at = words[end - 1][1]
    return b"".join([*keep, data[at:]]).decode("utf-8", "surrogatepass")


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    column: str = "scan",
    limit: int = SHARD_CHARS,
    cut: bool = False,
) -> DataFrame:
    """``docs`` with the struct ``column``: n_words, hits (word runs) and items (sorted ids).

    With ``cut`` it also has ``left``, the text without the hits: one pass of one worker does
    both. An existing column of that name is replaced.
    """
    short_batches(docs.sparkSession)
    out = docs.withColumn(column, F.lit(None).cast(f"STRUCT<{SCAN_FIELDS}>"))
    parts = shards(benchmark, limit)
    for k, part in enumerate(parts):
        out = out.withColumn(column, _scanner(part, n, cut and k + 1 == len(parts))(
            F.col("text"), F.col(column)
        ))
        if k + 1 < len(parts):  # one shard's tables in a task at a time
            out = kept(out, "decontaminate")
    return out


def hit_words(scan: Column) -> Column:
    return F.aggregate(
        scan["hits"],
        F.lit(0).cast("bigint"),
        lambda total, run: total + run["end"] - run["start"],
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.8
) -> DataFrame:
    """``docs`` with hit spans cut; documents of which more than ``drop_share`` is hit go.

    Returns the columns of ``docs``; ``n_chars``, if there, counts what is left.
    """
    (scanned,) = unused(docs, "scanned")
    found = scan(docs, benchmark, n, column=scanned, cut=True)
    found = found.where(
        (F.size(F.col(scanned)["hits"]) == 0)
        | (hit_words(F.col(scanned)) <= drop_share * F.col(scanned)["n_words"])
    )
    out = found.withColumn("text", F.col(scanned)["left"]).drop(scanned)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
