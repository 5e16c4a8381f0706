"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import in_few, kept

#: edges that are left at most when one task may name what they connect
LAST = 1 << 12


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, root) for every node with an edge; root is the smallest of the component.

    Each round puts all names in a new random order. A node takes the name of its first neighbour
    that comes before itself, and then the name which that one takes, so that about a third of the
    names of a path are left: rounds grow with the logarithm of the longest path. Edges get the new
    names, and loops and repeats go. The rounds end when no edge is left; a node's root is its name
    after all rounds. Only tables are passed on, each written to the shared folder, so a lost
    executor costs the round at most. Node groups are never collected. Edges with a null end count
    for nothing; an empty table gives no rows. Edges are counted in each round, and a round has no more
    tasks than so many edges need. The last ``LAST`` edges at most, whatever the input, need no rounds:
    one task names what they connect.
    """
    edges = kept(edges.where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    names: list[DataFrame] = []
    most = left = edges.count()
    while left > LAST:
        def placed(name: str) -> Column:
            return F.struct(F.xxhash64(F.lit(len(names)), name).alias("h"), F.col(name).alias("name"))

        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min(placed("b")).alias("first"))
        first = first.where(F.col("first") < placed("a")).select(F.col("a").alias("old"), F.col("first.name").alias("new"))
        first = kept(in_few(first, 2 * left), "first-names")
        then = first.select(F.col("old").alias("new"), F.col("new").alias("then"))
        taken = first.join(then, "new", "left").select("old", F.coalesce("then", "new").alias("new"))
        taken = kept(in_few(taken, 2 * left), "names")
        names.append(taken)
        moved = in_few(_renamed(in_few(_renamed(edges, "a", taken), left), "b", taken), left)
        edges = kept(in_few(moved.where("a <> b").distinct(), left), "edges")
        left = edges.count()
    if left:
        names.append(kept(_last_names(edges), "names"))
    roots = in_few(nodes.withColumn("root", F.col("node")), 2 * most)
    roots = kept(reduce(lambda rows, taken: in_few(_renamed(rows, "root", taken), 2 * most), names, roots), "last-names")
    smallest = roots.groupBy("root").agg(F.min("node").alias("new")).withColumnRenamed("root", "old")
    return _renamed(roots, "root", smallest)


def _renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    return rows.join(names, F.col(column) == F.col("old"), "left").withColumn(
        column, F.coalesce("new", column)
    ).drop("old", "new")


def _last_names(edges: DataFrame) -> DataFrame:
    """(old, new) of all ends of the last edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict = {}

        def name(x):
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                top[name(a)] = name(b)
        if top:
            kind = batch.schema.field("a").type
            new = [name(x) for x in list(top)]
            yield pa.RecordBatch.from_arrays([pa.array(list(top), kind), pa.array(new, kind)], ["old", "new"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"old {kind}, new {kind}")
