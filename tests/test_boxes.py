import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxlake.functions import boxes as B
from voxlake.functions import frames
from voxlake.schemas import BOX, NATIVE_SPACING_MM, TARGET_SPACING_MM


def box(*v):
    return F.struct(*[F.lit(x).cast("bigint").alias(n) for n, x in zip(BOX.fieldNames(), v, strict=True)])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ((0, 0, 0, 5, 5, 5), (0, 0, 0, 5, 5, 5), 1.0),
        ((0, 0, 0, 5, 5, 5), (10, 10, 10, 12, 12, 12), 0.0),
        ((0, 0, 0, 5, 5, 5), (5, 0, 0, 10, 5, 5), 36 / 396),
        ((0, 0, 0, 3, 3, 3), (2, 2, 2, 5, 5, 5), 8 / 120),
        ((0, 0, 0, 9, 9, 9), (3, 3, 3, 6, 6, 6), 64 / 1000),
    ],
)
def test_iou_closed_forms(spark, a, b, expected):
    assert one(spark, B.iou_3d(box(*a), box(*b))) == pytest.approx(expected)


def test_single_voxel_and_invalid_box(spark):
    assert one(spark, B.box_valid(box(1, 1, 1, 1, 1, 1)))
    assert one(spark, B.box_volume(box(1, 1, 1, 1, 1, 1))) == 1
    assert not one(spark, B.box_valid(box(2, 0, 0, 1, 5, 5)))
    with pytest.raises(PySparkException, match="min > max"):
        one(spark, B.assert_box(box(2, 0, 0, 1, 5, 5)))


def test_half_integer_center_and_extent(spark):
    assert one(spark, B.box_center(box(0, 0, 0, 5, 4, 1))) == [2.5, 2.0, 0.5]
    assert one(spark, B.box_extent(box(0, 0, 0, 5, 4, 1))) == [6, 5, 2]


def test_shape_stats(spark):
    s = one(spark, B.shape_stats(box(0, 0, 0, 9, 4, 1), (1.0, 1.0, 1.0)))
    assert (s["volume_mm3"], s["elongation"], s["anisotropy"]) == (100.0, 5.0, 2.0)
    flat = one(spark, B.shape_stats(box(0, 0, 0, 9, 4, 1), (0.0, 1.0, 1.0)))
    assert math.isinf(flat["elongation"])


def test_clip_inside_outside(spark):
    assert tuple(one(spark, B.box_clip(box(-3, 2, 2, 50, 5, 5), (10, 10, 10)))) == (0, 2, 2, 9, 5, 5)
    outside = box(20, 0, 0, 25, 5, 5)
    assert one(spark, B.box_clip(outside, (10, 10, 10), "null")) is None
    with pytest.raises(PySparkException):
        one(spark, B.box_clip(outside, (10, 10, 10)))


def test_contains_is_inclusive(spark):
    b = box(1, 1, 1, 4, 4, 4)
    for point, inside in (((1, 4, 2), True), ((0, 2, 2), False), ((5, 2, 2), False)):
        assert one(spark, B.box_contains(b, [F.lit(p) for p in point])) is inside


def test_known_truth_row(spark):
    center = [F.lit(189.0), F.lit(242.0), F.lit(314.0)]
    size = [F.lit(72.0), F.lit(368.0), F.lit(302.0)]
    found = one(spark, frames.csv_to_box(center, size))
    assert tuple(found) == (163, 58, 153, 465, 426, 225)


def test_fractional_endpoint_is_refused(spark):
    center, size = [F.lit(1.25)] * 3, [F.lit(2.0)] * 3
    assert one(spark, frames.integer_endpoint_check(center, size)) == "min_x"
    with pytest.raises(PySparkException, match="not an integer voxel"):
        one(spark, frames.csv_to_box(center, size))


corner = st.tuples(*[st.integers(0, 1000)] * 3)
extent = st.tuples(*[st.integers(0, 500)] * 3)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(corner, extent), min_size=40, max_size=40))
def test_frame_round_trips_are_exact(spark, rows):
    data = [(*lo, *(a + e for a, e in zip(lo, ext, strict=True))) for lo, ext in rows]
    df = spark.createDataFrame(data, BOX).select(B.box_from_columns().alias("b"))
    row = frames.box_to_csv(F.col("b"))
    back = frames.csv_to_box([row[f"c_{a}"] for a in "xyz"], [row[f"len_{a}"] for a in "xyz"])
    other = frames.yx_exclusive_to_box(frames.box_to_yx_exclusive(F.col("b")))
    assert df.where((back != F.col("b")) | (other != F.col("b"))).count() == 0


def test_roundtrip_identity_and_envelope(spark):
    b = box(163, 58, 153, 465, 426, 225)
    same = frames.box_grid_roundtrip(b, NATIVE_SPACING_MM, NATIVE_SPACING_MM)
    assert tuple(one(spark, same)) == (163, 58, 153, 465, 426, 225)
    recovered = frames.box_grid_roundtrip(b, TARGET_SPACING_MM, NATIVE_SPACING_MM)
    res = one(spark, frames.roundtrip_residuals(b, recovered, TARGET_SPACING_MM, NATIVE_SPACING_MM))
    assert res["envelope_vx"] == [3, 2, 2]
    assert res["gate_pass"] and res["failing_axes"] == []


def test_axis_swap_fails_the_structural_gate(spark):
    b, swapped = box(163, 58, 153, 465, 426, 225), box(58, 163, 153, 426, 465, 225)
    res = one(spark, frames.roundtrip_residuals(b, swapped, TARGET_SPACING_MM, NATIVE_SPACING_MM))
    assert not res["structural_pass"] and res["failing_axes"] == ["d0", "d1"]


def test_rounding_is_half_even(spark):
    slots = F.array(*[F.lit(v) for v in (0.5, 1.5, 2.5, 3.5, 4.5, 5.5)])
    assert tuple(one(spark, frames.slots_to_box(slots, frames.RESTORED_SLOTS))) == (0, 2, 4, 2, 4, 6)


def test_slot_boxes_are_widened_or_rejected(spark):
    thin = F.array(*[F.lit(v) for v in (3.0, 3.0, 3.0, 5.0, 3.0, 5.0)])
    assert tuple(one(spark, frames.slots_to_box(thin, frames.RESTORED_SLOTS))) == (3, 3, 3, 4, 5, 5)
    assert not one(spark, frames.slots_degenerate(thin, frames.RESTORED_SLOTS))
    bad = F.array(*[F.lit(v) for v in (3.0, 3.0, 2.0, 5.0, 3.0, 5.0)])
    assert one(spark, frames.slots_degenerate(bad, frames.RESTORED_SLOTS))


def test_tile_slots_round_trip(spark):
    b = box(1, 2, 3, 11, 12, 13)
    slots = frames.box_to_slots(b)
    assert one(spark, slots) == [3.0, 2.0, 13.0, 12.0, 1.0, 11.0]
    assert tuple(one(spark, frames.slots_to_box(slots, frames.TILE_SLOTS))) == (1, 2, 3, 11, 12, 13)


@pytest.mark.parametrize(
    ("permutation", "expected"),
    [([0, 1, 2], [1, 2, 11, 12, 3, 13]), ([1, 2, 0], [2, 3, 12, 13, 1, 11])],
)
def test_restore_identity_and_permutation(spark, permutation, expected):
    slots = F.array(*[F.lit(float(v)) for v in (1, 2, 11, 12, 3, 13)])
    ones, zeros = F.array(*[F.lit(1.0)] * 3), F.array(*[F.lit(0.0)] * 3)
    order = F.array(*[F.lit(p) for p in permutation])
    assert one(spark, frames.restore_slots(slots, order, ones, ones, zeros)) == expected


def test_resampled_size(spark):
    assert one(spark, frames.resampled_size(F.lit(865), 0.073, 0.3)) == 210
    assert one(spark, frames.resampled_size(F.lit(1), 0.073, 0.5)) == 1
    with pytest.raises(ValueError):
        frames.resampled_size(F.lit(1), 0.073, 0.0)


def test_grid_norm(spark):
    assert one(spark, frames.grid_norm(F.lit(0.0), 4)) == -0.75
    assert one(spark, frames.grid_norm(F.lit(3.0), 4, True)) == 1.0
    assert one(spark, frames.grid_norm(F.lit(0.0), 1, True)) == -1.0
