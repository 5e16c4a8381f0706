"""Near-copies by the exact similarity of shingle sets.

Words and shingles are those of ``simhash``; a text's set holds the 64-bit hash of each of its
distinct shingles. Two texts are linked if their sets have a Jaccard similarity of 0.8 or more.
Texts of equal sets meet in one key first, those without words in a key of their own.

Pairs that others propose (``simhash`` by its fingerprints) are compared first, and what they link
counts as connected in all that follows. Fingerprints only estimate a similarity, so the pairs that
they do not propose are sought exactly.

These candidates come from prefixes. All shingles have one order, the rarer in a sample first: if a
text's set has n shingles, each set similar to it shares one of its first n - ceil(0.8 n) + 1,
and the positions of the first shared one bound what both can share after it. Any order finds
all pairs, the sample only keeps frequent shingles out of the prefixes.

The texts that share a prefix shingle are its list. Not all pairs of a list are looked at:

1. ``STARS`` texts of each list are compared with every other one of it: those that have the fewest
   rarer shingles, as what others are edited from has none of theirs. Lists of up to ``STARS`` + 1 texts
   are done then. Later stars are the first ones in one random order of all texts.
2. Links make components. Texts of one component need no comparison, and what was a star is done
   with its list. The fewer places are left, the more stars a round has of a list. A group of
   near-copies comes together in a few rounds, so pairs grow with the texts, not with their square.
3. Sizes and positions rule out most pairs of a list whose texts only share a passage. These stars are a
   random part of a list, so what they leave of their pairs tells what all others will. Once this is
   no more than ``SPARSE`` times all places in lists, the pairs that are left are all compared, in
   bands of sizes: no pair at 0.8 is missed but for those whose texts are connected already.

A comparison has two steps: bitmaps of about a bit a shingle give each pair a lower bound of the
shingles that only one text has, and pairs that differ by too many end here; the others are compared
on the whole sets. Both work in tiles of bounded size, the second leaves out pairs that others of its
tile have connected. No pair below 0.8 is linked, but for collisions of 64-bit hashes.

Null texts are empty ones; texts without words are copies of one another. Repeated rows are copies.
Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import TASK_ROWS, in_few, kept, short_batches, whole
from voxlake.llm.components import components

#: one of so many keys is in the sample that tells frequent shingles
SAMPLE = 16
FREQUENT = 1 << 19
TILE = 512
#: texts of a list that are compared with all others in a round; more, if less than half of all places
#: in lists are left, so that a round makes at most ``STARS`` pairs for each of all places
STARS = 4
#: pairs for each place of a text in a list that may be left to the last step
SPARSE = 1
#: similar sets lie in one band of sizes or in two that follow one another: their sizes differ by a quarter at most
BAND = 1.26
#: rows with a set or a bitmap that a task gets at least, if there are as many
TASK_SETS = TASK_ROWS // 16
#: keys that a task remembers so as not to repeat a copy's shingles
SEEN = 1 << 17
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of all words, if there are fewer."""
    tokens = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.empty(0, np.int64)
    hashed = np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
    size = min(words, len(tokens))
    many = len(tokens) - size + 1
    mixed = np.full(many, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashed[k : k + many]) * np.uint64(_ODD)
        mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    return np.unique((mixed ^ mixed >> np.uint64(33)).view(np.int64))


def key_of(shingles: np.ndarray) -> int:
    """One number for a set, from -2**63."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set of which each similar set has one, in the common order."""
    count = np.zeros(len(shingles), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        count = np.where(frequent[at] == shingles, counts[at], 0)
    first = len(shingles) - (4 * len(shingles) + 4) // 5 + 1
    return shingles[np.lexsort((shingles, count))[:first]]


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by their low bits, in 2**k bits for the least 2**k >= n."""
    bits = max(8, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount(shingles & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ, the longer bitmap folded to the shorter: at most the shingles that do."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    folded = np.bitwise_xor.reduce(np.frombuffer(long, np.uint8).reshape(-1, len(short)), axis=0).tobytes()
    return (int.from_bytes(short, "little") ^ int.from_bytes(folded, "little")).bit_count()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.8 or more, in whole numbers."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if 5 * len(short) < 4 * len(long):
        return False
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    shared = int((long[at] == short).sum())
    return 9 * shared >= 4 * (len(a) + len(b))


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, key and bitmap of each row, and the shingles of the sampled keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sample, bits, done = [], [], [], set()
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, words)
                key = key_of(shingles)
                keys.append(key)
                bits.append(bitmap(shingles))
                new = key % SAMPLE == 0 and key not in done
                done.add(key)
                sample.append(shingles if new else None)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.int64())]
            columns += [pa.array(bits, pa.binary()), pa.array(sample, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "key", "bits", "sample"])

    rows = docs.select("doc_id", F.xxhash64(whole(F.col("text"))).alias("text_hash"), whole(F.col("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash BIGINT, key BIGINT, bits BINARY, sample ARRAY<BIGINT>")


def _frequent(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the sample, sorted, and their counts."""
    sample = marked.where("sample IS NOT NULL").select("key", F.explode("sample").alias("s"))
    counts = sample.distinct().groupBy("s").count().where("count > 1")
    most = counts.orderBy(F.desc("count"), "s").limit(FREQUENT).toArrow()
    shingles, counted = (most.column(c).to_numpy() for c in ("s", "count"))
    order = np.argsort(shingles)
    return shingles[order], counted[order]


def _posts(docs: DataFrame, words: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """The shingles of each key's prefix, with position and the set's size, for lists of two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, sizes, parts = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, words)
                key = key_of(shingles)
                if not len(shingles) or key in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                keys.append(key)
                sizes.append(len(shingles))
                parts.append(prefix(shingles, frequent, counts))
            if not keys:
                continue
            many = [len(p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(parts)),
                    pa.array(np.repeat(np.array(keys, np.int64), many)),
                    pa.array(np.concatenate([np.arange(m, dtype=np.int32) for m in many])),
                    pa.array(np.repeat(np.array(sizes, np.int32), many)),
                ],
                ["s", "key", "at", "n"],
            )

    rows = docs.select(whole(F.col("text")).alias("text"))
    posts = rows.mapInArrow(run, "s BIGINT, key BIGINT, at INT, n INT")
    posts = kept(posts, "posts")
    # most shingles stand in one text only and end here; the aggregate combines before it shuffles
    shared = posts.groupBy("s").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    return posts.join(shared.select("s"), "s", "left_semi").distinct()


def _sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """key and its set, of those in ``need`` (key, text_hash); one text of each is read again."""
    rows = docs.select(F.xxhash64(whole(F.col("text"))).alias("text_hash"), whole(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, sets = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                keys.append(key)
                sets.append(shingle_set(text, words).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "shingles"]
            )

    texts = rows.join(need, "text_hash").select("key", "text")
    return texts.mapInArrow(run, "key BIGINT, shingles BINARY").dropDuplicates(["key"])


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links (a, b) that connect what the pairs ``left`` of one tile connect."""
    keys = right.column("key").to_pylist()
    sets = {k: np.frombuffer(s, np.int64) for k, s in zip(keys, right.column("shingles").to_pylist(), strict=True)}
    root = {k: k for k in keys}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found: tuple[list, list] = ([], [])
    for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
        x, y = top(a), top(b)
        if x != y and similar(sets[a], sets[b]):
            root[x] = y
            found[0].append(a)
            found[1].append(b)
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def _close(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs (a, b) of one tile whose bitmaps allow a similarity of 0.8."""
    keys, sizes, maps = (right.column(c).to_pylist() for c in ("key", "n", "bits"))
    known = {k: (n, m) for k, n, m in zip(keys, sizes, maps, strict=True)}
    found: tuple[list, list] = ([], [])
    for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
        (n, x), (m, y) = known[a], known[b]
        # 9 * shared >= 4 * (n + m), and n + m - 2 * shared shingles differ
        if 9 * differing(x, y) <= n + m:
            found[0].append(a)
            found[1].append(b)
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.selectExpr("explode(array(a, b)) AS key").distinct()


def _in_tiles(pairs: DataFrame, many: int, values: DataFrame, count: int, compare) -> DataFrame:
    """``compare`` of the ``many`` pairs, tile by tile, and of the rows of ``values`` that they name."""
    blocks = max(1, -(-count // TILE))
    a, b = (F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int") for c in "ab")
    tiled = pairs.select("a", "b", F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    ends = in_few(tiled.selectExpr("i AS p", "j AS q", "explode(array(a, b)) AS key").distinct(), 2 * many)
    used = in_few(ends.join(values, "key"), 2 * many, TASK_SETS).groupBy("p", "q")
    return tiled.groupBy("i", "j").cogroup(used).applyInArrow(compare, "a BIGINT, b BIGINT")


class _Verifier:
    """Compares pairs (a, b) of keys in two steps; texts of keys are read again where needed."""

    def __init__(self, docs: DataFrame, marked: DataFrame, sizes: DataFrame, words: int) -> None:
        self.docs, self.words = docs, words
        first = marked.groupBy("key").agg(F.first("bits").alias("bits"), F.min("text_hash").alias("text_hash"))
        self.maps = kept(in_few(first.join(sizes, "key"), marked.count(), TASK_SETS), "maps")

    def linked(self, pairs: DataFrame) -> DataFrame:
        many = pairs.count()
        keys = kept(in_few(_ends(pairs), 2 * many), "keys")
        close = kept(in_few(_in_tiles(pairs, many, self.maps.drop("text_hash"), keys.count(), _close), many, TASK_SETS), "close-pairs")
        many = close.count()
        # written first, as a small table of hashes is broadcast then and the texts stay where they are
        need = self.maps.select("key", "text_hash").join(in_few(_ends(close), 2 * many), "key", "left_semi")
        need = kept(in_few(need, 2 * many), "needed")
        ends = need.count()
        sets = kept(in_few(_sets(self.docs, need, self.words), ends, TASK_SETS), "sets")
        return kept(in_few(_in_tiles(close, many, sets, ends, _compare), many, TASK_SETS), "links")


def _pairs(x: DataFrame, y: DataFrame, condition: str) -> DataFrame:
    """Pairs (a, b) of keys of ``x`` and ``y`` (posts) in one list whose sets may be similar, and how often."""
    # what both sets can still share from these positions on must be enough
    enough = "9L * least(x.n - x.at, y.n - y.at) >= 4L * (x.n + y.n)"
    joined = x.alias("x").join(y.alias("y"), F.expr(f"x.s = y.s AND x.key <> y.key AND {condition}"))
    ends = F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")
    return joined.where(enough).groupBy(*ends).agg(F.count("*").alias("times"))


def _last_pairs(open_: DataFrame) -> DataFrame:
    """All pairs of different components that are left in lists; each meets in one band of its list."""
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
    own = open_.withColumn("band", band)
    near = own.withColumn("band", F.explode(F.expr("sequence(band - 1, band + 1)")))
    return _pairs(own, near, "x.band = y.band AND x.key < y.key AND x.root <> y.root")


def _tried(counts: DataFrame, stars: DataFrame) -> float:
    """How many pairs of different components ``stars`` make with their lists, of ``counts`` (s, root, c)."""
    own = stars.groupBy("s", "root").agg(F.count("*").cast("double").alias("k"))
    rows = counts.join(own, ["s", "root"], "left").fillna(0.0, ["k"])
    lists = rows.groupBy("s").agg((F.sum("k") * F.sum("c") - F.sum(F.col("k") * F.col("c"))).alias("pairs"))
    return lists.where("pairs > 0").agg(F.sum("pairs")).first()[0] or 1.0


def _proposed_keys(marked: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of each key with the first of its group; a key without a shared shingle is like no other."""
    texts = marked.select("text_hash", "key").distinct().join(groups, "text_hash")
    many = marked.count()
    texts = in_few(texts.select("group", "key"), many).distinct()
    grouped = kept(in_few(texts, many).join(sizes.select("key"), "key"), "grouped-keys")
    many = grouped.count()
    first = grouped.groupBy("group").agg(F.min("key").alias("a"))
    pairs = grouped.join(first, "group").where("a < key").select("a", F.col("key").alias("b"))
    return in_few(in_few(pairs, many).distinct(), many)


def _with_roots(posts: DataFrame, found: DataFrame) -> DataFrame:
    """``posts`` with the component of each key as ``root``."""
    roots = kept(components(found), "roots")
    rows = posts.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    return rows.drop("node")


def links(docs: DataFrame, marked: DataFrame, words: int, proposed: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between keys that connect all similar ones.

    ``proposed`` (text_hash, group) names groups of texts; each is compared with the first of its
    group before any others are.
    """
    posts = kept(_posts(docs, words, *_frequent(marked)), "shared-posts")
    places = posts.count()
    sizes = posts.groupBy("key").agg(F.first("n").alias("n"))
    verifier = _Verifier(docs, marked, sizes, words)
    found: DataFrame | None = None
    place, first = [F.xxhash64("key"), F.col("key")], [F.col("at")]
    open_, many, counts = posts.withColumn("root", F.col("key")), STARS, None
    if proposed is not None:
        found = verifier.linked(kept(_proposed_keys(marked, proposed, sizes), "proposed"))
        open_ = kept(in_few(_with_roots(posts, found), places), "open-posts")
    while True:
        stars = open_.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy(*first, *place)))
        stars = kept(stars.where(F.col("rank") <= many), "stars")
        pairs = kept(_pairs(open_, stars, "x.root <> y.root"), "pairs")
        # the share of the stars' pairs that sizes and positions allow
        share = 1.0 if counts is None else (pairs.agg(F.sum("times")).first()[0] or 0) / _tried(counts, stars)
        new = verifier.linked(pairs)
        found = new if found is None else found.unionByName(new)
        # stars are done with their lists, and so are lists of one component
        rest = open_.join(stars.select("s", "key"), ["s", "key"], "left_anti").drop("root")
        rest = kept(in_few(_with_roots(in_few(rest, places), found), places), "open-posts")
        counts = rest.groupBy("s", "root").agg(F.count("*").cast("double").alias("c"))
        counts = kept(in_few(counts, places), "counts")
        lists = counts.groupBy("s").agg(
            ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")
        ).where("pairs > 0")
        lists = kept(in_few(lists, places), "lists")
        left = lists.agg(F.sum("pairs")).first()[0]
        if not left:
            return found
        open_ = kept(in_few(rest.join(lists.select("s"), "s", "left_semi"), places), "open-posts")
        if left * share <= SPARSE * places:
            last = kept(_last_pairs(open_), "pairs")
            return found.unionByName(verifier.linked(last))
        many, first = max(STARS, STARS * places // open_.count()), []


def copy_groups(docs: DataFrame, words: int = 5, proposed: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, text_hash and the name of the group, a row each.

    ``proposed`` (text_hash, group) names groups of texts that are likely to be copies.
    """
    short_batches(docs.sparkSession)
    marked = kept(_marked(docs, words), "shingle-keys")
    roots = components(links(docs, marked, words, proposed))
    rows = marked.select("doc_id", "text_hash", "key")
    return rows.join(roots, F.col("key") == F.col("node"), "left").select(
        "doc_id", "text_hash", F.coalesce("root", "key").alias("copies")
    )
