"""Phrases of two and three words that occur together more often than their parts would.

Texts are cut into pieces at sentence marks and line ends, pieces into words at spaces and tabs;
A to Z are lower-cased. Everything is counted per language.

1. First passes: n-grams are hashed, a hash dealt to a hash partition. Tasks add up what they hold
   before it is shuffled. Each partition is a mergeable Misra-Gries summary: counters of two
   summaries are added and, if there are more than the capacity, the largest one beyond it is
   subtracted from all. There are so many partitions that the capacity exceeds a partition's mass
   divided by ``least``; then less than ``least`` is subtracted in all, and whatever occurs ``least``
   times keeps a counter, to which no more than what was subtracted is missing. Should one
   partition get more (its size is left to hashes), it keeps more counters rather than subtract
   that much.
2. The hashes that may be frequent mark bits of a map of fixed size. It only saves work: an n-gram that
   shares its bit with a survivor is counted too, and left out when its count is known. Words and
   pairs come first, then those triples whose two pairs are marked.
3. Second pass: the n-grams whose bit is set are counted exactly, by their words.
4. Each way of cutting a phrase in two is one row; the counts of both parts join it. Parts that
   begin or end very many phrases (at most ``HEAVY`` of them, by their share) are broadcast, all
   others shuffled. A phrase inside a longer one that has at least half its count goes.

Null texts are empty, a null language is ``und``. Repeated rows count as often as they occur. Ties are
ranked by count and then phrase. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import kept, short_batches, whole, worker_state

LONGEST = 3
#: counters of one summary, about; a partition's mass is ``least`` times as much
COUNTERS = 1 << 19
#: log2 of the bits of the map of survivors
MAP_BITS = 27
#: word positions that a task holds before it adds up its n-grams
HELD = 1 << 20
#: words that a worker remembers the hashes of
MEMO = 400_000
HEAVY = 1_000

_BREAK = np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
# A-Z to lower case, the marks at which pieces end to line feeds, tabs to spaces
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b
    for b in range(256)
)


class _Words(dict):
    """Hashes of words; unknown ones are computed when they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word) | 2
        return value


def tokens_of(texts: list[str]) -> list[bytes]:
    """Words of texts with a line feed after each piece; empty ones stand for repeated spaces."""
    data = "\n".join(texts).encode("utf-8", "surrogatepass").translate(_PLAIN)
    return data.replace(b"\n", b" \n ").split(b" ")


def token_hashes(tokens: list[bytes], known: _Words) -> np.ndarray:
    if len(known) > MEMO:
        known.clear()
    known[b""], known[b"\n"] = 0, int(_BREAK)
    hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    return hashes


def gram_hashes(hashes: np.ndarray, salt: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each place, and whether no piece ends in it; no empty words inside."""
    many = max(0, len(hashes) - size + 1)
    out = np.full(many, salt & (1 << 64) - 1, np.uint64)
    good = np.ones(many, bool)
    for k in range(size):
        part = hashes[k : k + many]
        good &= part != _BREAK
        out = (out ^ part) * _MIX
        out ^= out >> np.uint64(31)
    return out * _MIX, good


def _salt(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=7)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of one language at a time, about ``HELD`` of them together; a text is never cut."""
    parts: dict[str, list[list[bytes]]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            tokens = tokens_of(some)
            parts.setdefault(lang, []).append(tokens)
            sizes[lang] = sizes.get(lang, 0) + len(tokens)
        # many languages together hold no more than one
        while sum(sizes.values()) > HELD:
            lang = max(sizes, key=sizes.get)
            yield lang, _chained(parts.pop(lang))
            del sizes[lang]
    for lang, some in parts.items():
        yield lang, _chained(some)


def _chained(parts: list[list[bytes]]) -> list[bytes]:
    out: list[bytes] = []
    for part in parts:
        out += part
        out.append(b"\n")
    return out


def _summed(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and their total counts."""
    if counts is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, int)
    if counts is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - MAP_BITS)
    return (marks[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _candidates(hashes: np.ndarray, salt: int, size: int, marks: np.ndarray | None) -> np.ndarray:
    """Hashes of the n-grams of a size whose ends, one word shorter, are both marked."""
    found, good = gram_hashes(hashes, salt, size)
    if marks is not None and len(found):
        ends = _marked(marks, gram_hashes(hashes, salt, size - 1)[0])
        good &= ends[:-1] & ends[1:]
    return found[good]


def partial_counts(rows: DataFrame, buckets: int, sizes: tuple[int, ...], marks: np.ndarray | None = None) -> DataFrame:
    """``rows`` (lang, text) to (bucket, grams, counts): what each task found, by hash partition."""
    shared = None if marks is None else rows.sparkSession.sparkContext.broadcast(marks)
    version = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks = worker_state("phrases", version, lambda: (_Words(), shared and shared.value))
        for lang, tokens in _held(batches):
            hashes = token_hashes(tokens, known)
            hashes = hashes[hashes != 0]
            grams = [_candidates(hashes, _salt(lang), size, marks) for size in sizes]
            values, counts = _summed(np.concatenate(grams))
            # hash partitions are ranges of hashes
            cuts = np.searchsorted(values, _edges(buckets))
            cuts[-1] = len(values)
            some = np.flatnonzero(np.diff(cuts))
            for at in range(0, len(some), 64):
                near = some[at : at + 64].tolist()
                parts = [slice(cuts[b], cuts[b + 1]) for b in near]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(near, pa.int32()),
                    "grams": pa.array([values[x].tobytes() for x in parts], pa.binary()),
                    "counts": pa.array([_narrow(counts[x]) for x in parts], pa.binary()),
                })

    return rows.mapInArrow(run, "bucket INT, grams BINARY, counts BINARY")


def _edges(buckets: int) -> np.ndarray:
    """Where the hash partitions begin; the last edge lies beyond all hashes."""
    step = (1 << 64) // buckets
    return np.array([step * k for k in range(buckets)] + [(1 << 64) - 1], np.uint64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts below 256 in one byte each, others in eight."""
    kind = np.uint8 if counts.max() < 256 else np.int64
    return counts.astype(kind).tobytes()


def _wide(data: bytes, many: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == many else np.int64).astype(np.int64)


class Summary:
    """A mergeable Misra-Gries summary: sorted hashes and positive counters.

    A counter is below the true count by ``error`` at most, and ``error`` stays below ``least``.
    """

    def __init__(self, capacity: int, least: int) -> None:
        self.capacity, self.least, self.error = capacity, least, 0
        self.grams, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.many = 0

    def merge(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Another summary joins this one."""
        if self.many + len(grams) > max(self.capacity, len(self.grams)):
            self.settle()
        self.waiting.append((grams, counts))
        self.many += len(grams)

    def settle(self) -> None:
        values = np.concatenate([self.grams, *(g for g, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.many = [], 0
        values, counts = _summed(values, counts)
        if len(values) > self.capacity:
            beyond = len(counts) - self.capacity - 1
            less = min(int(np.partition(counts, beyond)[beyond]), self.least - 1 - self.error)
            if less > 0:
                self.error += less
                counts = counts - less
                values, counts = values[counts > 0], counts[counts > 0]
        self.grams, self.counts = values, counts


def survivors(partial: DataFrame, least: int, capacity: int) -> DataFrame:
    """``partial_counts`` to (first_bit, bits, kept_grams): the slice of the map of each partition.

    Rows come sorted by partition, so that a task holds one summary at a time.
    """

    def slice_of(summary: Summary) -> pa.RecordBatch:
        summary.settle()
        # a counter lacks ``error`` at most
        often = summary.grams[summary.counts + summary.error >= least]
        bits = (often >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        first = int(bits[0]) >> 3 << 3 if len(bits) else 0
        flags = np.zeros(((int(bits[-1]) - first) // 8 + 1) * 8 if len(bits) else 0, np.uint8)
        flags[bits - first] = 1
        return pa.RecordBatch.from_pydict({
            "first_bit": pa.array([first], pa.int64()),
            "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()),
            "kept_grams": pa.array([len(bits)], pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, bucket = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "grams", "counts")]
            for b, grams, counts in zip(*columns, strict=True):
                if b != bucket:
                    if summary is not None and (len(summary.grams) or summary.many):
                        yield slice_of(summary)
                    summary, bucket = Summary(capacity, least), b
                values = np.frombuffer(grams, np.uint64)
                summary.merge(values, _wide(counts, len(values)))
        if summary is not None:
            yield slice_of(summary)

    dealt = partial.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "first_bit BIGINT, bits BINARY, kept_grams BIGINT")


def _counted(places: list[np.ndarray], many: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of word places (below ``many``) and their counts."""
    width = max(1, many.bit_length())
    if width * len(places) < 64:
        key = places[0]
        for place in places[1:]:
            key = key << width | place
        key, counts = _summed(key)
        shifts = [(len(places) - 1 - k) * width for k in range(len(places))]
        return [key >> s & (1 << width) - 1 for s in shifts], counts
    number = places[0]
    for place in places[1:]:  # too many words for one number: pairs are numbered anew
        _, number = np.unique(number * many + place, return_inverse=True)
    _, first, counts = np.unique(number, return_index=True, return_counts=True)
    return [place[first] for place in places], counts


def exact_counts(rows: DataFrame, marks: np.ndarray, longest: int) -> DataFrame:
    """(lang, size, phrase, a) of the n-grams whose bit is set; words are joined by spaces.

    Size 0 and the empty phrase stand for all words of a language.
    """
    shared = rows.sparkSession.sparkContext.broadcast(marks)
    version = uuid.uuid4().hex

    def rows_of(lang: str, size: int, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(phrases), 50_000):
            some = phrases[lo : lo + 50_000]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(some), pa.string()),
                "size": pa.array([size] * len(some), pa.int32()),
                "phrase": some,
                "a": pa.array(counts[lo : lo + 50_000], pa.int64()),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks = worker_state("phrases", version, lambda: (_Words(), shared.value))
        for lang, tokens in _held(batches):
            hashes = token_hashes(tokens, known)
            here = hashes != 0
            hashes = hashes[here]
            yield from rows_of(lang, 0, pa.array([""]), np.array([(hashes != _BREAK).sum()]))
            words = pa.array(tokens, pa.binary()).filter(pa.array(here)).dictionary_encode()
            place = words.indices.to_numpy().astype(np.int64)
            names = words.dictionary.cast(pa.string())
            for size in range(1, longest + 1):
                found, good = gram_hashes(hashes, _salt(lang), size)
                at = np.flatnonzero(good & _marked(marks, found))
                if not len(at):
                    continue
                parts, counts = _counted([place[at + k] for k in range(size)], len(names))
                taken = [names.take(pa.array(p)) for p in parts]
                phrases = pc.binary_join_element_wise(*taken, " ") if size > 1 else taken[0]
                yield from rows_of(lang, size, phrases, counts)

    found = rows.mapInArrow(run, "lang STRING, size INT, phrase STRING, a BIGINT")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a"))


def frequent_grams(docs: DataFrame, least: int = 10, longest: int = LONGEST, counters: int = COUNTERS) -> DataFrame:
    """``docs`` (lang, text) to (lang, size, phrase, a): all n-grams that occur ``least`` times or
    more, and the number of words of each language as size 0, if there are so many."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole(F.col("text")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word has one byte and one beside it, at least, so half the bytes bound the words
    marks = None
    for sizes in [tuple(range(1, min(2, longest) + 1)), *((k,) for k in range(3, longest + 1))]:
        mass = size * len(sizes) // 2
        buckets = -(-mass // (counters * least)) or 1
        partial = partial_counts(rows, buckets, sizes, marks)
        more = np.zeros(1 << MAP_BITS - 3, np.uint8) if marks is None else marks.copy()
        for row in survivors(partial, least, counters).select("first_bit", "bits").toLocalIterator():
            bits = np.frombuffer(row.bits, np.uint8)
            more[row.first_bit >> 3 : (row.first_bit >> 3) + len(bits)] |= bits
        marks = more
    return kept(exact_counts(rows, marks, longest).where(F.col("a") >= least), "frequent")


def _with_counts(cuts: DataFrame, grams: DataFrame, part: str, name: str, total: int) -> DataFrame:
    """``cuts`` with the count of the phrase in column ``part``, as ``name``."""
    sizes = cuts.groupBy("lang", part).count()
    heavy = sizes.where(F.col("count") > max(1, total // HEAVY)).select("lang", part)
    known = grams.where("size > 0").select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    heavy = kept(known.join(heavy, ["lang", part]), "heavy-parts")  # at most HEAVY rows
    marked = cuts.join(F.broadcast(heavy), ["lang", part], "left")
    rest = marked.where(F.col(name).isNull()).drop(name).join(known, ["lang", part])
    return marked.where(F.col(name).isNotNull()).unionByName(rest)


def mine(
    docs: DataFrame, least: int = 10, most: int = 2_000, counters: int = COUNTERS, inside: int = 50
) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    grams = frequent_grams(docs, least, LONGEST, counters)
    phrases = grams.where("size > 1")
    word = F.split("phrase", " ", -1)
    both = phrases.select(
        "lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), word.alias("w")
    ).select(
        "lang", "phrase", "size", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    total = both.count()
    cuts = _with_counts(both, grams, "first", "l", total)
    cuts = _with_counts(cuts, grams, "rest", "r", total)
    # counts reach 2**63, so products are decimals of 38 digits
    exact = "CAST({} AS DECIMAL(19, 0))".format
    score = F.expr(f"({exact('1000000')} * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    # two-word ends of three-word phrases, with the larger count
    longer = phrases.where("size = 3").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.array(F.array_join(F.slice(word, 1, 2), " "), F.array_join(F.slice(word, 2, 2), " "))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))
    )
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    flat = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # the best of each of some parts of a language first: no task takes a whole language
    part = flat.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(max(16, total // 1_000_000))))
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    best = best.where(F.col("rank") <= most).drop("_part", "rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    words = grams.where("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.where(F.col("rank") <= most).join(words, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
