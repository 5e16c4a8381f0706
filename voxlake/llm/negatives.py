"""Hard negatives for anchors by threshold joins over an index pruned with norms.

Components become whole numbers, a score is an integer inner product. Index vectors are packed in
strips. In a strip the dimensions are put in order, those with the least energy first, and taken in
groups. For a threshold:

* A vector's leading groups need no postings while their norm times the anchor's is below the
  threshold: no match has its whole score there. Only the rest is indexed.
* Anchors go through the index from the last group back and add up partial scores. A pair is given
  up when what it has plus the product of both remaining norms is below the threshold.
* Pairs that are left add the groups that were not indexed; their scores are exact.
* The threshold starts at half of the largest possible score of an anchor and is lowered for those
  whose windows are not full, to a quarter, an eighth and so on, then to zero, then to below every
  score. A window's own lower end stops the search earlier.

The first join finds an anchor's positives, the second, with their scores as windows, its negatives.
A strip gives at most ``k`` rows a window, and the best of all strips remain: the stated anchors
against all rows, in blocks.

Rows whose label, vector or a component is null, or a component not finite, take no part, nor do
rows whose squared norm passes 2**61, as their scores would not fit a long. Vectors of different
lengths: missing components are zero. Rows with one vec_id are one row, with the least label and
vector; a null vec_id names no row. Ties go to the smaller vec_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import kept

STRIP = 16_384
ANCHORS = 512  # in a block of anchors
TOGETHER = 64  # anchors compared with a strip at once
GROUPS = 8
MOST = 1 << 61  # of a squared norm

FOUND = "anchor_id BIGINT, window INT, vec_id BIGINT, score BIGINT"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, x) of the rows that take part; ``x`` holds whole numbers as longs."""
    value = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < (1 << 31) / scale))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", F.col("label").cast("bigint"), value.alias("x"))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    one = rows.where(norm < MOST).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row"))
    return one.select("vec_id", "row.label", "row.x")


def strips(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` (vec_id, label, x) packed in strips of about ``size``: numbers from 0, none left out."""
    count = max(1, -(-rows.count() // size))
    # as many spare bits as a long can give: a hash decides, so strips are about equal
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        x = group.column("x").combine_chunks()
        lengths = np.diff(np.asarray(x.offsets))
        matrix = np.zeros((len(x), lengths.max()), np.int64)
        matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = x.flatten().to_numpy()
        return pa.table({
            name: group.column(name)[:1],
            "dim": pa.array([matrix.shape[1]], pa.int32()),
            "ids": pa.array([group.column("vec_id").to_numpy().tobytes()], pa.binary()),
            "labels": pa.array([group.column("label").to_numpy().tobytes()], pa.binary()),
            "x": pa.array([matrix.tobytes()], pa.binary()),
        })

    schema = f"{name} INT, dim INT, ids BINARY, labels BINARY, x BINARY"
    return dealt.groupBy(name).applyInArrow(packed, schema)


def _matrix(dim: int, x: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(x, np.int64).reshape(-1, dim) if dim else np.zeros((0, 0), np.int64)
    return np.pad(rows, ((0, 0), (0, width - dim)))


class Strip:
    """The index of one strip: dimensions in groups, and the norm of each vector before each group."""

    def __init__(self, x: np.ndarray) -> None:
        energy = (x.astype(float) ** 2).sum(0)
        self.order = np.argsort(energy, kind="stable")
        self.x = np.ascontiguousarray(x[:, self.order])
        self.cuts = np.unique(np.linspace(0, x.shape[1], GROUPS + 1).astype(int))
        self.norms = self.norms_before(self.x)
        self.columns = [np.ascontiguousarray(self.x[:, a:b].T) for a, b in zip(self.cuts, self.cuts[1:])]

    def norms_before(self, x: np.ndarray) -> np.ndarray:
        squares = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x.astype(float) ** 2, axis=1)], axis=1)
        return np.sqrt(squares[:, self.cuts])

    def at_least(self, anchors: np.ndarray, threshold: np.ndarray, allowed: np.ndarray) -> tuple:
        """(anchor, row, score) of all allowed pairs with a score from the anchor's threshold on.

        ``anchors`` are rows in the order of dimensions of ``x`` as given; all sums are exact.
        """
        q = anchors[:, self.order]
        q_norms = self.norms_before(q)
        # sums below 2**53 are exact as doubles in any order, others are left to whole numbers
        exact = float(q_norms[:, -1].max(initial=0)) * float(self.norms[:, -1].max(initial=0)) < 2.0**52
        kind = np.float64 if exact else np.int64
        q = q.astype(kind)
        limit = threshold[:, None].astype(float)
        slack = 1 + 1e-9  # of the norms' rounding
        # a vector is indexed from the first group that a match may not do without
        longest = np.maximum(q_norms[:, -1], 1e-300)
        need = (threshold / longest).min(initial=np.inf) if len(q) else np.inf
        scores = np.zeros(allowed.shape, kind)
        alive = allowed & (q_norms[:, -1:] * self.norms[:, -1] * slack + 0.5 >= limit)
        added = np.zeros(len(self.x), np.int64)  # groups taken from the end
        groups = len(self.cuts) - 1
        for g in range(groups - 1, -1, -1):
            posted = (self.norms[:, g + 1] * slack >= need) & alive.any(0)
            rows = np.flatnonzero(posted)
            if not len(rows):
                break
            added[rows] = groups - g
            part = self.columns[g][:, rows].astype(kind)
            scores[:, rows] += q[:, self.cuts[g] : self.cuts[g + 1]] @ part
            rest = q_norms[:, g : g + 1] * self.norms[rows, g] * slack
            alive[:, rows] &= scores[:, rows] + rest + 0.5 >= limit
        a, r = np.nonzero(alive)
        found = scores[a, r]
        # groups that were not posted
        for g in range(groups):
            some = np.flatnonzero(added[r] < groups - g)
            if len(some):
                lo, hi = self.cuts[g], self.cuts[g + 1]
                found[some] += np.einsum("ij,ij->i", q[a[some], lo:hi], self.x[r[some], lo:hi].astype(kind))
        found = found.astype(np.int64)
        good = found >= threshold[a]
        return a[good], r[good], found[good]


def _lowered(top: np.ndarray) -> Iterator[np.ndarray]:
    """Thresholds from half of the largest possible scores down to below all of them."""
    for k in range(1, 5):
        yield np.ceil(top / 2**k)
    yield np.zeros(len(top))
    yield -top - 1


def search(strip: Strip, ids, labels, anchor_ids, anchor_labels, anchors, low, high, k, same):
    """(anchor, window, row, score): the first ``k`` rows of the strip in each window of each anchor.

    ``low`` and ``high`` (anchor × window) bound the scores of a window, both inclusive; windows
    with ``low`` above ``high`` are empty. Rows are those with the anchor's label, itself not, or
    with ``same`` false those with another one.
    """
    out: list[tuple[np.ndarray, ...]] = []
    allowed = (labels[None] == anchor_labels[:, None]) == same
    allowed &= ids[None] != anchor_ids[:, None]
    norms = strip.norms_before(anchors[:, strip.order])[:, -1]
    top = np.ceil(norms * strip.norms[:, -1].max(initial=0) * (1 + 1e-9)) + 1
    open_ = (low <= high) & (low <= top[:, None])
    for bound in _lowered(top):
        todo = np.flatnonzero(open_.any(1))
        if not len(todo):
            break
        # no lower than the lowest window that is still open
        floor = np.where(open_[todo], low[todo], np.inf).min(1)
        least = np.maximum(bound[todo], floor)
        a, r, s = strip.at_least(anchors[todo], least, allowed[todo])
        order = np.lexsort((ids[r], -s, a))
        a, r, s = todo[a[order]], r[order], s[order]
        threshold = np.full(len(norms), np.inf)
        threshold[todo] = least
        for w in range(low.shape[1]):
            inside = np.flatnonzero(open_[a, w] & (s >= low[a, w]) & (s <= high[a, w]))
            owner = a[inside]
            first = np.searchsorted(owner, owner)  # owners are sorted
            inside = inside[np.arange(len(inside)) - first < k]
            full = np.bincount(a[inside], minlength=len(norms)) >= k
            # full, or nothing of the window lies below the threshold
            done = open_[:, w] & (full | (threshold <= low[:, w])) & np.isfinite(threshold)
            inside = inside[done[a[inside]]]
            out.append((a[inside], np.full(len(inside), w), r[inside], s[inside]))
            open_[done, w] = False
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _join(blocks: DataFrame, index: DataFrame, count: int, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows of each window of each anchor in each strip (``FOUND``).

    ``blocks`` hold packed anchors and ``windows``: bounds as doubles, low and high, anchor by
    anchor; none stands for one window without bounds.
    """
    asked = blocks.select(
        "block", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("labels").alias("q_labels"),
        F.col("x").alias("q_x"), "windows", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("strip"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = max(row["dim"], row["q_dim"], 1)
                strip = Strip(_matrix(row["dim"], row["x"], width))
                ids, labels, q_ids, q_labels = (
                    np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "q_ids", "q_labels")
                )
                anchors = _matrix(row["q_dim"], row["q_x"], width)
                if row["windows"] is None:
                    windows = np.tile([-np.inf, np.inf], (len(q_ids), 1, 1))
                else:
                    windows = np.frombuffer(row["windows"]).reshape(len(q_ids), -1, 2)
                for at in range(0, len(q_ids), TOGETHER):
                    part = slice(at, at + TOGETHER)
                    a, w, r, s = search(
                        strip, ids, labels, q_ids[part], q_labels[part], anchors[part],
                        windows[part, :, 0], windows[part, :, 1], k, same,
                    )
                    yield pa.RecordBatch.from_pydict({
                        "anchor_id": pa.array(q_ids[part][a], pa.int64()),
                        "window": pa.array(w, pa.int32()),
                        "vec_id": pa.array(ids[r], pa.int64()),
                        "score": pa.array(s, pa.int64()),
                    })

    tasks = asked.join(index, "strip").repartition(F.xxhash64("strip", "block"))
    return tasks.mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows(blocks: DataFrame, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """``blocks`` with the windows of their anchors: a score's ``low`` to ``high`` hundredths."""
    lists = positives.groupBy("block", "anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("scores")
    )
    by_block = lists.groupBy("block").agg(F.collect_list(F.struct("anchor_id", "scores")).alias("known"))

    @F.arrow_udf("BINARY")
    def packed(ids: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for q_ids, rows in zip(ids.to_pylist(), known.to_pylist(), strict=True):
            at = {i: n for n, i in enumerate(np.frombuffer(q_ids, np.int64).tolist())}
            windows = np.tile([np.inf, -np.inf], (len(at), k, 1))  # empty ones
            for row in rows or ():
                for p in row["scores"]:
                    # 100 * score from low * p to high * p: whole numbers, so ends round inwards
                    ends = (-(-low * p["score"] // 100), high * p["score"] // 100)
                    windows[at[row["anchor_id"]], p["rank"] - 1] = ends
            out.append(windows.tobytes())
        return pa.array(out, pa.binary())

    joined = blocks.drop("windows").join(by_block, "block", "left")
    return joined.withColumn("windows", packed("ids", "known")).drop("known")


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    strip: int = STRIP,
) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) to the negatives of each anchor and positive.

    Anchors are the rows whose vec_id ``every`` divides, positives the first rows of their label,
    negatives the first rows of other labels whose score is ``low`` to ``high`` hundredths of the
    positive's. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = kept(quantized(vectors), "whole-vectors")
    index = kept(strips(rows, strip, "strip"), "strips")
    count = max(1, -(-rows.count() // strip))
    chosen = rows.where(F.col("vec_id") % every == 0)
    blocks = kept(strips(chosen, ANCHORS, "block").withColumn("windows", F.lit(None).cast("binary")), "anchors")
    near = kept(_first(_join(blocks, index, count, positives, True), positives), "positives")
    many = max(1, -(-chosen.count() // ANCHORS))
    placed = near.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(many)).cast("int"))
    asked = kept(_windows(blocks, placed, positives, low, high), "windows")
    far = _first(_join(asked, index, count, negatives, False), negatives)
    pairs = near.select(
        "anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return far.join(pairs, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def rotated_labels(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``vectors`` with the label of every row whose vec_id ``every`` divides moved on by one."""
    moved = ((F.col("label") + 1) % labels).cast(vectors.schema["label"].dataType)
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, moved).otherwise(F.col("label")))
