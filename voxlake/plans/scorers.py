"""Scorers as hooks: a function of DataFrames, or a batch function that runs inside tasks.

A scorer turns case ids into candidate rows. Its output has a declared schema, and what departs
from it fails before anything is written: names and types when the plan is made or a batch comes
in, the width of vectors in the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from voxlake.errors import ScorerError

BatchFn = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def schema_problems(declared: list[tuple[str, str]], found: list[tuple[str, str]]) -> list[str]:
    """Sentences on columns that lack, are of another type, or are not declared."""
    have, want = dict(found), dict(declared)
    out = [f"column {n!r} is missing" for n in want if n not in have]
    out += [f"column {n!r} is {have[n]}, declared is {t}" for n, t in want.items() if n in have and have[n] != t]
    return out + [f"column {n!r} is not declared" for n in have if n not in want]


def enforced(scored: DataFrame, schema: T.StructType, dim: int | None = None, vector: str = "embedding") -> DataFrame:
    """``scored`` in the declared column order; raises ``ScorerError`` if names or types differ.

    With ``dim`` the job fails on a row whose ``vector`` is null or has another width.
    """
    bad = schema_problems(
        [(f.name, f.dataType.simpleString()) for f in schema.fields],
        [(f.name, f.dataType.simpleString()) for f in scored.schema.fields],
    )
    if bad:
        raise ScorerError("; ".join(bad))
    rows = scored.select(*schema.fieldNames())
    if dim is None:
        return rows
    message = F.concat(
        F.lit(f"{ScorerError.__name__}: {vector} must have {dim} entries, got "),
        F.coalesce(F.size(F.col(vector)).cast("string"), F.lit("none")),
    )
    checked = F.when(F.size(F.col(vector)) == dim, F.col(vector)).otherwise(F.raise_error(message))
    return rows.withColumn(vector, checked)


class BatchScorer:
    """Scores Arrow batches of case ids in the tasks that hold them.

    ``score`` gets the batches of ``case_id`` of one task, so that it can load a model once, and
    yields batches of candidates. Each is compared with ``schema`` before it leaves the task.
    """

    def __init__(self, score: BatchFn, schema: T.StructType, dim: int | None = None) -> None:
        self.score, self.schema, self.dim = score, schema, dim

    def __call__(self, cases: DataFrame) -> DataFrame:
        score, names = self.score, self.schema.fieldNames()
        declared = [(f.name, f.dataType.simpleString()) for f in self.schema.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in score(batches):
                bad = schema_problems(declared, [(f.name, from_arrow_type(f.type).simpleString()) for f in batch.schema])
                if bad:
                    raise ScorerError("; ".join(bad))
                yield batch.select(names)

        return enforced(cases.select("case_id").mapInArrow(run, self.schema), self.schema, self.dim)
