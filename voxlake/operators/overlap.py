"""All overlapping box pairs between two tables of the same cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions import boxes as B
from voxlake.operators.levels import CELL, cell_rows, corner_cell, level_of, level_range, levels_apart, marked_range
from voxlake.schemas import AXES


#: blocks of a hot case's rows on either side, at most
MOST_BLOCKS = 8


def _row_hash(df: DataFrame) -> Column:
    """A hash of the row's own content: the same in a repeated task."""
    maps = (T.MapType, T.VariantType)
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, maps)])


def _overlap(a: Column, b: Column, volumes: Column, threshold: float) -> tuple[Column, Column]:
    """The test for an IoU above ``threshold`` and the IoU, of boxes with the sum ``volumes``.

    Conditions of joins compute what stands in them twice twice. So a bound, a hair low for its rounding,
    settles most pairs with one intersection, and the exact test follows.
    """
    inter = B.intersection_volume(a, b)
    # the test divides once and needs no zero case: an empty intersection is never above 0
    iou = inter / (volumes - inter)
    least = volumes * F.lit(threshold / (1 + threshold) * (1 - 1e-9))
    return (inter > least) & (iou > threshold), iou


def iou_join(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    left_box: str = "left_box",
    right_box: str = "right_box",
    case: str = "case_id",
    cell: int = 8,
    max_group: int = 4096,
    only: Column | None = None,
) -> DataFrame:
    """Pairs within a case with IoU strictly above ``threshold``, with their ``iou``.

    ``only`` is a condition on columns of both sides; boxes are looked at where it holds.

    Cases with more than ``max_group`` squared pairs are blocked on the level grid of ``levels``,
    whose finest cells have edges of ``cell``. From a threshold of 0.5 on, a pair shares more than
    half of either box on every axis and so contains both centres: right boxes stand in the cells
    they touch on their own level, left ones in the cell of their centre on this level and its
    neighbours. Below that the side with the smaller box looks for the other on its level, and a
    pair is reported only in the cell that holds the lower corner of its intersection. Either way
    no duplicates need removing. The rows of a hot case are dealt into up to ``MOST_BLOCKS`` blocks
    on either side by a hash of the row, and each block meets each block of the other side, so that
    the pairs of one hot cell are the work of many tasks.
    Where no case is hot, which one count of both sides tells, the sides are joined on the case alone
    and nothing but their own columns is shuffled.
    Column names other than the case must differ between the sides.
    """
    if threshold < 0:
        raise ValueError("a threshold below 0 would pair all boxes of a case")
    # the coarsest levels are needed only where boxes of any two levels may overlap
    apart = levels_apart(threshold)
    tops = [level_of(F.col(box), cell) if apart is None else F.lit(None) for box in (left_box, right_box)]
    sizes = [
        df.groupBy(case).agg(F.count("*").cast("double").alias(n), F.max(top).alias(name))
        for df, n, top, name in zip((left, right), ("_nl", "_nr"), tops, ("_tl", "_tr"), strict=True)
    ]
    pairs = F.col("_nl") * F.col("_nr") / (float(max_group) * max_group)
    blocked = sizes[0].join(sizes[1], case).where(pairs > 1).select(
        # a case is left to its cells until it has twice the bound: the grid parts it already
        case, F.least(F.lit(MOST_BLOCKS), F.floor(F.sqrt(pairs))).cast("int").alias("_parts"), "_tl", "_tr"
    )
    wanted = F.lit(True) if only is None else only
    if blocked.isEmpty():
        a, b = F.col(left_box), F.col(right_box)
        above, iou = _overlap(a, b, B.box_volume(a) + B.box_volume(b), threshold)
        return left.join(right, case).where(wanted & above).withColumn("iou", iou)
    sides = []
    for df, box, volume, own, dealt, met in (
        (left, left_box, "_vl", "_ol", "_i", "_j"), (right, right_box, "_vr", "_or", "_j", "_i")
    ):
        side = df.withColumn("_h", _row_hash(df)).join(blocked, case, "left")
        side = side.withColumns({
            "_blocked": F.col("_parts").isNotNull(),
            volume: B.box_volume(F.col(box)),
            own: level_of(F.col(box), cell),
            dealt: F.pmod(F.col("_h"), F.coalesce("_parts", F.lit(1))).cast("int"),
            met: F.explode_outer(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)),
        })
        sides.append(side.drop("_h", "_parts"))
    a, b, ol, or_, hot = (F.col(c) for c in (left_box, right_box, "_ol", "_or", "_blocked"))
    if threshold >= 0.5:
        first = cell_rows(sides[0], a, level_range(F.greatest(F.lit(0), ol - 1), ol + 1), cell, True, hot)
        second = cell_rows(sides[1], b, level_range(or_, or_), cell, active=hot)
    else:
        last = [F.col(top) if apart is None else own + apart for top, own in (("_tr", ol), ("_tl", or_))]
        # without a mark the right box's level is no finer than the left one's, with one it is
        up_left = F.concat(level_range(ol, last[0]), marked_range(ol, ol))
        up_right = F.concat(level_range(or_, or_), marked_range(or_ + 1, last[1]))
        first = cell_rows(sides[0], a, up_left, cell, active=hot)
        second = cell_rows(sides[1], b, up_right, cell, active=hot)
    at_corner = F.lit(True)
    for i, axis in enumerate(AXES if threshold < 0.5 else ()):
        at_corner = at_corner & (~hot | (corner_cell(a, b, axis, F.col("_level"), cell) == F.col(f"_c{i}")))
    above, iou = _overlap(a, b, F.col("_vl") + F.col("_vr"), threshold)
    keys = [case, "_blocked", *CELL, "_i", "_j"]
    return (
        first.drop("_tl", "_tr").join(second.drop("_tl", "_tr"), keys)
        # the corner test is cheap and settles most repeated pairs
        .where(wanted & at_corner & above)
        .withColumn("iou", iou)
        .drop("_vl", "_vr", "_ol", "_or", *keys[1:])
    )
