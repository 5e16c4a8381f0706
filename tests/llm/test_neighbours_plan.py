"""The plan of the nearest neighbours on tables that Spark thinks small."""

import numpy as np

from voxlake.llm import neighbours


def test_repeated_queries_are_not_broadcast(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert found.count() == 150
