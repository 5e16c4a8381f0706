"""SimHash near-duplicates by tiled exact comparison.

A text's words are its runs of other than ASCII white space after A-Z are lower-cased; its
shingles are all runs of ``words`` words (all words together, if there are fewer), repeats
included. A fingerprint bit is set if it is set in more than half of the shingles' hashes
(XXH64, seed 42; further 64-bit words of longer fingerprints use the next seeds). A text without
words, null included, has the fingerprint zero and is linked like any other.

Links are all pairs of distinct fingerprints within ``radius`` bits, found by comparing tiles of
fingerprints with exclusive-or and bit counts. The population count of any part of two
fingerprints differs by at most their distance, so fingerprints are ordered by the counts of
``parts`` equal parts, cut into strips of equal size and these into tiles, and pairs of strips
and tiles whose counts differ by more than ``radius`` in sum are skipped. No other pair is left
out: the links are exact. Strips number as the fingerprints divided by ``STRIP``, so a task
holds two strips whatever the input; each fingerprint travels once per strip pair.

The comparison is quadratic in the number of distinct fingerprints, less what is skipped: with
a small radius the skipped share grows with the input, with a wide one it does not.

A task returns a spanning forest of the links it finds, never all pairs of a group. Documents
with equal fingerprints meet in one row first. Repeated rows and ids are linked through their
fingerprints; null ids never are a component's smallest. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import drop_state, kept, short_batches, unused, whole
from voxlake.llm.components import components
from voxlake.llm.jaccard import copy_groups

STRIP = 1 << 17
LEAST_STRIPS = 12
TILE = 256
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 15


def fingerprint_of(text: str, words: int, bits: int) -> str:
    tokens = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return "0" * (bits // 4)
    size = min(words, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = list(zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True))
    counts = np.zeros(bits, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(spans), _BLOCK):
        block = [joined[a:b] for a, b in spans[at : at + _BLOCK]]
        for word in range(bits // 64):
            h = np.array([hashed(s, SEED + word) for s in block], ">u8")
            bit = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
            counts[64 * word : 64 * word + 64] += bit.sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(spans)).tobytes().hex()


def fingerprint(text: Column, words: int = 3, bits: int = 64) -> Column:
    """Fingerprint as lower-case hexadecimal digits; ``bits`` is a multiple of 64."""

    @F.arrow_udf("STRING")
    def run(texts: pa.Array) -> pa.Array:
        drop_state()
        return pa.array([fingerprint_of(t, words, bits) for t in texts.to_pylist()], pa.string())

    return run(whole(text))


def _words_of(prints: list[str], bits: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.frombuffer(bytes.fromhex("".join(prints)), ">u8").reshape(-1, bits // 64).astype(np.uint64)


def part_counts(rows: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of ``parts`` equal parts of each fingerprint."""
    octets = rows.astype(">u8").view(np.uint8).reshape(len(rows), parts, -1)
    return np.bitwise_count(octets).sum(2, dtype=np.int64)


def tile_order(prints: Column, bits: int, parts: int) -> Column:
    """A number that orders fingerprints by the counts of their parts, then by their bits."""

    @F.arrow_udf("BIGINT")
    def run(values: pa.Array) -> pa.Array:
        rows = _words_of(values.to_pylist(), bits)
        order = np.zeros(len(rows), np.int64)
        for count in part_counts(rows, parts).T:
            order = order << 6 | np.minimum(count * 64 // (bits // parts + 1), 63)
        rest = 62 - 6 * parts
        mixed = np.bitwise_xor.reduce(rows * np.uint64(0x9E3779B97F4A7C15), axis=1)
        return pa.array(order << rest | (mixed >> np.uint64(64 - rest)).astype(np.int64))

    return run(prints)


def _gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Least sum of differences of counts between members of two boxes, for all pairs of boxes."""
    apart = np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None])
    return np.maximum(apart, 0).sum(2)


class Forest:
    """Union of linked members, kept flat so that whole arrays of links are reduced at once."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)
        self.edges: list[tuple[int, int]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        apart = ra != rb
        if not apart.any():
            return
        _, first = np.unique(np.minimum(ra, rb)[apart] * len(self.root) + np.maximum(ra, rb)[apart], return_index=True)
        a, b, ra, rb = (x[apart][first].tolist() for x in (a, b, ra, rb))
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for x, y, rx, ry in zip(a, b, ra, rb, strict=True):
            tx, ty = top(rx), top(ry)
            if tx != ty:
                parent[max(tx, ty)] = min(tx, ty)
                self.edges.append((x, y))
        moved = np.arange(len(self.root))
        moved[list(parent)] = [top(x) for x in parent]
        self.root = moved[self.root]


def compare_strips(left: np.ndarray, right: np.ndarray, same: bool, radius: int, parts: int) -> list:
    """Spanning edges of the links between two strips: positions in left, then right."""
    offset = 0 if same else len(left)
    rows = left if same else np.concatenate([left, right])
    forest = Forest(len(rows))

    def boxes(strip):
        at = np.arange(0, len(strip), TILE)
        counts = part_counts(strip, parts)
        return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)

    near = _gap(*boxes(left), *boxes(right)) <= radius
    xor = np.empty((TILE, TILE), np.uint64)
    for i, j in zip(*np.nonzero(near), strict=True):
        if same and j < i:
            continue
        a, b = left[i * TILE : (i + 1) * TILE], right[j * TILE : (j + 1) * TILE]
        view = xor[: len(a), : len(b)]
        distance = np.zeros(view.shape, np.uint8)
        for word in range(left.shape[1]):
            np.bitwise_xor(a[:, word, None], b[None, :, word], out=view)
            distance += np.bitwise_count(view)
        close = distance <= radius
        if close.any():
            x, y = np.nonzero(close)
            x, y = x + i * TILE, y + j * TILE + offset
            apart = x != y
            forest.link(x[apart], y[apart])
    return forest.edges


def links(prints: DataFrame, radius: int, bits: int = 64, parts: int = 4) -> DataFrame:
    """``prints`` (fingerprint, distinct) to edges (a, b) that connect all linked fingerprints."""
    count = prints.count()
    strips = max(LEAST_STRIPS, -(-count // STRIP))
    ordered = prints.select("fingerprint", tile_order(F.col("fingerprint"), bits, parts).alias("o"))
    ordered = kept(ordered, "ordered")
    cuts = ordered.agg(
        F.percentile_approx("o", [k / strips for k in range(1, strips)], 100 * strips)
    ).first()[0]
    bounds = np.array(sorted(set(cuts or [])), np.int64)
    last = len(bounds)

    @F.arrow_udf("INT")
    def strip_of(order: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, order.to_numpy(), "left").astype(np.int32))

    def packed(group: pa.Table) -> pa.Table:
        prints = group.column("fingerprint").to_numpy()[np.argsort(group.column("o").to_numpy(), kind="stable")]
        rows = _words_of(prints.tolist(), bits)
        counts = part_counts(rows, parts)
        return pa.table(
            {
                "i": group.column("i")[:1],
                "rows": pa.array([rows.tobytes()], pa.binary()),
                "low": pa.array([counts.min(0).tolist()], pa.list_(pa.int64())),
                "high": pa.array([counts.max(0).tolist()], pa.list_(pa.int64())),
            }
        )

    strips = kept(
        ordered.withColumn("i", strip_of("o"))
        .groupBy("i")
        .applyInArrow(packed, "i INT, rows BINARY, low ARRAY<BIGINT>, high ARRAY<BIGINT>"),
        "strips",
    )
    other = strips.selectExpr("i AS j", "rows AS rows_j", "low AS low_j", "high AS high_j")
    gap = """aggregate(zip_with(arrays_zip(low, high), arrays_zip(low_j, high_j),
      (x, y) -> greatest(0, x.low - y.high_j, y.low_j - x.high)), 0L, (s, x) -> s + x)"""
    # first the pairs of strips, by their counts alone, then the fingerprints of these
    pairs = (
        strips.select("i", "low", "high")
        .withColumn("j", F.explode(F.sequence("i", F.lit(last))))
        .join(other.drop("rows_j"), "j")
        .where(f"{gap} <= {radius}")
        .select("i", "j")
    )
    tasks = pairs.join(strips.select("i", "rows"), "i").join(other.select("j", "rows_j"), "j")
    width = bits // 64

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left = np.frombuffer(row["rows"], np.uint64).reshape(-1, width)
                right = np.frombuffer(row["rows_j"], np.uint64).reshape(-1, width)
                same = row["i"] == row["j"]
                edges = compare_strips(left, right, same, radius, parts)
                every = left if same else np.concatenate([left, right])
                ends = np.array(edges, np.int64).reshape(-1, 2)
                a, b = (
                    [r.tobytes().hex() for r in every[ends[:, k]].astype(">u8")] for k in (0, 1)
                )
                yield pa.RecordBatch.from_pydict(
                    {"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())}
                )

    dealt = tasks.repartition(F.xxhash64("i", "j"))
    return dealt.mapInArrow(compare, "a STRING, b STRING")


def near_groups(
    docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 2, parts: int = 4
) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, text_hash, fingerprint and component_id, a row each.

    ``component_id`` is the smallest doc_id reachable over links, its own included.
    """
    short_batches(docs.sparkSession)
    text = F.col("text")
    marked = docs.select(
        "doc_id",
        F.xxhash64(whole(text)).alias("text_hash"),
        fingerprint(text, words, bits).alias("fingerprint"),
    )
    marked = kept(marked, "fingerprints")
    classes = kept(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    edges = links(classes.select("fingerprint"), radius, bits, parts)
    roots = components(edges)
    named = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    member = named.join(smallest, "root").select("fingerprint", "component_id")
    return marked.join(member, "fingerprint").select(
        "doc_id", "text_hash", "fingerprint", "component_id"
    )


def one_of_each(docs: DataFrame, words: int = 5, radius: int = 3) -> DataFrame:
    """``docs`` without near-copies: of each group the row with the smallest doc_id stays.

    The components of fingerprints within ``radius`` bits propose pairs. Fingerprints only estimate a
    similarity, so each pair is compared on its shingle sets, and those that fingerprints do not
    propose are sought there (see ``jaccard``): all pairs at 0.8 and more are linked and none below.
    Rows that are equal in doc_id and text count as one. Null ids come first.
    """
    texts = docs.select("doc_id", "text")
    # texts go by their hash here, as ids may be null or repeated
    hashed = texts.select(F.xxhash64(whole(F.col("text"))).alias("doc_id"), "text")
    near = near_groups(hashed, words, radius=radius)
    proposed = kept(near.select("text_hash", F.col("component_id").alias("group")).distinct(), "proposed-groups")
    groups = copy_groups(texts, words, proposed)
    stay = groups.groupBy("copies").agg(F.min(F.struct("doc_id", "text_hash")).alias("s"))
    # a null id takes a number of its own, so that plain equality joins and deals it
    keys = unused(docs, "number", "text_hash")
    number = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    stay = stay.select("s.*").select(number.alias(keys[0]), F.col("text_hash").alias(keys[1]))
    text_hash = F.xxhash64(whole(F.col("text")))
    rows = docs.withColumns({keys[0]: number, keys[1]: text_hash})
    return rows.join(stay, keys, "left_semi").dropDuplicates(keys).drop(*keys)
