"""Linear resampling to a finer grid, next to the sum over all source voxels."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import voxels as VX

SPACING, TARGET, SIZE = (0.3, 0.5, 0.4), (0.2, 0.45, 0.5), (9, 6, 5)


def axis_weights(size, spacing, target):
    """Per output index the source indices and weights, as the scattered form has them."""
    step, last = target / spacing, size - 1
    out = []
    for o in range(max(1, round(size * spacing / target))):
        at = o * step
        if at > last + 0.5:
            out.append({last: 0.0})
        else:
            near = {i: 1 - abs(min(at, last) - i) for i in range(size)}
            out.append({i: w for i, w in near.items() if w > 0})
    return out


@pytest.mark.parametrize("edge", [2, 4, 32])
def test_finer_grids_equal_the_sum_over_voxels(spark, monkeypatch, edge):
    monkeypatch.setattr(VX, "BRICK", edge)
    rng = np.random.default_rng(5)
    rows = []
    for case in (1, 2, 3):
        for at in itertools.product(*map(range, SIZE)):
            copies = 1 if case == 1 else int(rng.choice([0, 1, 2], p=[0.6, 0.3, 0.1]))
            rows += [(case, *at, None if case == 3 and rng.random() < 0.5 else int(rng.integers(256))) for _ in range(copies)]
    rows += [(1, -1, 0, 0, 7), (1, 9, 0, 0, 7), (2, None, 0, 0, 7)]
    frame = spark.createDataFrame(rows, "case_id long, d0 int, d1 int, d2 int, intensity int")
    sizes = spark.createDataFrame([(c, *SIZE) for c in (1, 2, 3)], "case_id long, n_d0 long, n_d1 long, n_d2 long")
    found = VX.resample_volume(frame, sizes, SPACING, TARGET)
    # partial sums of outputs, more than the voxels, are not shuffled
    assert "partial_sum" not in found._jdf.queryExecution().executedPlan().toString()
    assert [f.simpleString() for f in found.schema] == [
        "case_id:bigint", "d0:bigint", "d1:bigint", "d2:bigint", "intensity:double"]
    got = {tuple(r)[:4]: r["intensity"] for r in found.collect()}
    cells = defaultdict(list)
    for case, *at, value in rows:
        cells[(case, *at)].append(value)
    axes = [axis_weights(*x) for x in zip(SIZE, SPACING, TARGET, strict=True)]
    want = {}
    for case in (1, 2, 3):
        for out in itertools.product(*(range(len(a)) for a in axes)):
            reads = [axes[k][o] for k, o in enumerate(out)]
            met = [(v, np.prod([reads[k][i] for k, i in enumerate(at)])) for at in itertools.product(*reads) for v in cells[(case, *at)]]
            if met:
                known = [v * w for v, w in met if v is not None]
                want[(case, *out)] = pytest.approx(sum(known)) if known else None
    assert got == want


def test_finer_volume_without_a_size_fails(spark):
    frame = spark.range(1).select(F.col("id").alias("case_id"), *[F.lit(0).alias(a) for a in ("d0", "d1", "d2")], F.lit(1).alias("intensity"))
    sizes = spark.createDataFrame([(5, 1, 1, 1)], "case_id long, n_d0 long, n_d1 long, n_d2 long")
    with pytest.raises(Exception, match="no size"):
        VX.resample_volume(frame, sizes, SPACING, TARGET).collect()
