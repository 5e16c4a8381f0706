"""Detection-like views over the driver tables, as DataFrames and as SQL.

Each view exists twice: a DataFrame for the Spark queries and a SQL text that the
checking database inlines as a common table expression. Both are whole-table,
integer derivations, so they agree row for row.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.boxes import box_from_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than cores.

    The test tables are single files, which one task would read and compute. A table
    of many files already has more splits and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


GRID_ROWS = 1_000_000


def spread_grids(df: DataFrame, cells: int) -> DataFrame:
    """Rows that a grid of ``cells`` each is made of, so that a task makes ``GRID_ROWS`` at most.

    The bytes of the input say nothing of the grids: a file of one split can hold them all.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() * cells // GRID_ROWS)))


CASES_SQL = """
SELECT o_orderkey AS case_id,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'M' ELSE 'B' END AS label
FROM orders
"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS case_id",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'M' ELSE 'B' END AS label",
    )


_PROPOSAL_COLUMNS = """
  CAST((l_orderkey - l_orderkey % 25) / 25 AS BIGINT) AS case_id,
  CAST((l_linenumber - 1) % 5 AS INT) AS fold,
  ((l_orderkey % 25) * 8 + l_linenumber) * 1000000000000000 + l_partkey * 10000000
    + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000 AS det_idx,
  CAST((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 13) % 1000 AS DOUBLE) / 1000 AS score,
  l_partkey % 24 AS min_d0,
  l_suppkey % 24 AS min_d1,
  (l_partkey + l_suppkey) % 24 AS min_d2,
  l_partkey % 24 + 23 + CAST(l_quantity AS BIGINT) % 12 AS max_d0,
  l_suppkey % 24 + 23 + (CAST(l_quantity AS BIGINT) * 5) % 12 AS max_d1,
  (l_partkey + l_suppkey) % 24 + 23 + (CAST(l_quantity AS BIGINT) * 7) % 12 AS max_d2,
  l_partkey % (SELECT max(vec_id) + 1 FROM {embeddings}) AS vec_id
"""

_PROPOSALS = f"SELECT {_PROPOSAL_COLUMNS} FROM {{lineitem}}"
PROPOSALS_SQL = _PROPOSALS.format(lineitem="lineitem", embeddings="embeddings")


def _split_columns(text: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


def proposals_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as detections; between them they name every embedding."""
    return spark.sql(
        _PROPOSALS,
        lineitem=table(spark, sf_dir, "lineitem"),
        embeddings=table(spark, sf_dir, "embeddings"),
    )


def proposals(spark: SparkSession, sf_dir: str, embeddings: bool = False) -> DataFrame:
    """Detections of five folds, about 100 per case, with tied scores."""
    rows = proposals_flat(spark, sf_dir).select(
        "case_id",
        "fold",
        "det_idx",
        "score",
        box_from_columns().alias("box"),
        F.array("fold").alias("source_detectors"),
        "vec_id",
    )
    if embeddings:
        vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        rows = rows.join(vectors, "vec_id")
    return rows


EMBEDDING_DIM = 64

TRUTH_SQL = """
SELECT case_id, len_x, len_y, len_z,
  (k % 24) + len_x / 2 AS c_x, (k % 19) + len_y / 2 AS c_y, (k % 17) + len_z / 2 AS c_z
FROM (SELECT case_id, k, CAST(23 + k % 12 AS DOUBLE) AS len_x,
    CAST(23 + (k * 5) % 12 AS DOUBLE) AS len_y, CAST(23 + (k * 7) % 12 AS DOUBLE) AS len_z
  FROM (SELECT CAST((o_orderkey - o_orderkey % 25) / 25 AS BIGINT) AS case_id, max(o_custkey) AS k
    FROM orders GROUP BY 1) g) s
"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One center/size box per case; the endpoints are integers."""
    keyed = (
        table(spark, sf_dir, "orders")
        .groupBy(F.expr("CAST((o_orderkey - o_orderkey % 25) / 25 AS BIGINT)").alias("case_id"))
        .agg(F.max("o_custkey").alias("k"))
    )
    sized = keyed.selectExpr(
        "case_id",
        "k",
        "CAST(23 + k % 12 AS DOUBLE) AS len_x",
        "CAST(23 + (k * 5) % 12 AS DOUBLE) AS len_y",
        "CAST(23 + (k * 7) % 12 AS DOUBLE) AS len_z",
    )
    return sized.selectExpr(
        "case_id",
        "len_x",
        "len_y",
        "len_z",
        "(k % 24) + len_x / 2 AS c_x",
        "(k % 19) + len_y / 2 AS c_y",
        "(k % 17) + len_z / 2 AS c_z",
    )


_VOXEL_COLUMNS = """
  case_id, d0, d1, d2,
  CAST((case_id * 7 + d0 * 3 + d1 * 5 + d2 * 11) % 256 AS INT) AS intensity,
  CASE WHEN d0 BETWEEN 2 + case_id % 4 AND 9 + case_id % 4
        AND d1 BETWEEN 3 + case_id % 5 AND 11 + case_id % 5
        AND d2 BETWEEN 1 + case_id % 3 AND 6 + case_id % 3 THEN 1 ELSE 0 END AS mask
"""
VOXEL_SHAPE = (16, 20, 12)

VOXELS_SQL = f"""
SELECT {_VOXEL_COLUMNS} FROM (
  SELECT s_suppkey AS case_id, CAST(id // 240 AS INT) AS d0, CAST(id % 240 // 12 AS INT) AS d1,
    CAST(id % 12 AS INT) AS d2
  FROM supplier CROSS JOIN range(3840) t(id)) x
"""


def _grid(df: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    for axis, n in zip(("d0", "d1", "d2"), shape, strict=True):
        df = df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16 x 20 x 12 image and box mask per supplier."""
    cases_ = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"))
    return _grid(spread_grids(cases_, prod(VOXEL_SHAPE)), VOXEL_SHAPE).selectExpr(*_split_columns(_VOXEL_COLUMNS))


LOG_SQL = """
SELECT CAST(user_id % 5 AS INT) AS fold, event_id AS line_no,
  concat('2026-01-01 | INFO | ', CASE WHEN event_type = 'error'
      THEN 'validation_epoch_end:268 - Val loss reached: '
    WHEN event_type = 'click' THEN 'heartbeat '
    ELSE 'training_epoch_end:251 - Train loss reached: ' END,
    CAST(CAST(value AS DECIMAL(10,2)) - CAST(60 AS DECIMAL(10,2)) AS VARCHAR(40))) AS line
FROM events
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered training-log lines per fold, with negative losses and noise."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id % 5 AS INT) AS fold",
        "event_id AS line_no",
        """concat('2026-01-01 | INFO | ', CASE WHEN event_type = 'error'
             THEN 'validation_epoch_end:268 - Val loss reached: '
           WHEN event_type = 'click' THEN 'heartbeat '
           ELSE 'training_epoch_end:251 - Train loss reached: ' END,
           CAST(CAST(value AS DECIMAL(10,2)) - CAST(60 AS DECIMAL(10,2)) AS STRING)) AS line""",
    )


_METRIC_COLUMNS = """
  run_id,
  concat(CASE WHEN i >= 15 THEN '0_' ELSE '' END,
    CASE WHEN i % 15 < 9 THEN concat('FROC_score_IoU_0.', CAST(i % 15 + 1 AS VARCHAR(4)), '0')
      WHEN i % 15 < 14 THEN concat('AP_IoU_0.', CAST(i % 15 - 8 AS VARCHAR(4)), '0_MaxDet_100')
      ELSE 'mAP_IoU_0.10_0.50_0.05_MaxDet_100' END) AS metric,
  CASE WHEN (run_id + i) % 17 = 0 THEN 'nan'
    ELSE concat('0.', lpad(CAST((run_id * 37 + i * 101) % 10000 AS VARCHAR(8)), 4, '0')) END AS val
"""

METRICS_SQL = f"""
SELECT {_METRIC_COLUMNS}
FROM (SELECT c_custkey AS run_id, CAST(id AS INT) AS i FROM customer CROSS JOIN range(17) t(id)) x
"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-valued metrics of one run per customer, with "nan" and class duplicates."""
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    numbered = runs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(16))))
    return numbered.selectExpr(*_split_columns(_METRIC_COLUMNS))


FILES_SQL = """
SELECT split, kind, concat(split, '/', kind, '/',
    CASE WHEN split = 'Train' AND kind = 'DATA'
      THEN concat('shard', CAST(case_id % 2 AS VARCHAR(2)), '/') ELSE '' END,
    kind, '_', CASE WHEN case_id < 1000
      THEN lpad(CAST(case_id AS VARCHAR(12)), CASE WHEN kind = 'DATA' THEN 3 ELSE 4 END, '0')
      ELSE CAST(case_id AS VARCHAR(12)) END, '.nrrd') AS path
FROM (SELECT o_orderkey AS case_id, o_totalprice,
    CASE WHEN o_orderkey % 10 < 5 THEN 'Train' WHEN o_orderkey % 10 < 7 THEN 'Validation'
      ELSE 'Test' END AS split FROM orders) o
  CROSS JOIN (SELECT 'DATA' AS kind UNION ALL SELECT 'MASK') k
WHERE kind = 'DATA' OR o_totalprice >= 6000
UNION ALL
SELECT 'Train', 'DATA', concat('Train/DATA/copy/DATA_', CAST(o_orderkey AS VARCHAR(12)), '.nrrd')
FROM orders WHERE o_orderkey % 10 < 5 AND o_totalprice > 495000
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File catalog: sharded Train, uneven padding, missing masks, a few duplicates."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS case_id",
        "o_totalprice",
        """CASE WHEN o_orderkey % 10 < 5 THEN 'Train' WHEN o_orderkey % 10 < 7
             THEN 'Validation' ELSE 'Test' END AS split""",
    )
    kinds = orders.withColumn(
        "kind",
        F.explode(
            F.when(F.col("o_totalprice") >= 6000, F.array(F.lit("DATA"), F.lit("MASK"))).otherwise(
                F.array(F.lit("DATA"))
            )
        ),
    )
    listed = kinds.selectExpr(
        "split",
        "kind",
        """concat(split, '/', kind, '/',
             CASE WHEN split = 'Train' AND kind = 'DATA'
               THEN concat('shard', CAST(case_id % 2 AS STRING), '/') ELSE '' END,
             kind, '_', CASE WHEN case_id < 1000
               THEN lpad(CAST(case_id AS STRING), CASE WHEN kind = 'DATA' THEN 3 ELSE 4 END, '0')
               ELSE CAST(case_id AS STRING) END, '.nrrd') AS path""",
    )
    copies = orders.where("split = 'Train' AND o_totalprice > 495000").selectExpr(
        "'Train' AS split",
        "'DATA' AS kind",
        "concat('Train/DATA/copy/DATA_', CAST(case_id AS STRING), '.nrrd') AS path",
    )
    return listed.unionByName(copies)


TILES_SQL = """
SELECT case_id, CAST(id AS INT) AS tile_idx, CAST(id % 2 * 12 AS BIGINT) AS o_d0,
  CAST(id // 2 % 2 * 12 AS BIGINT) AS o_d1, CAST(id // 4 * 12 AS BIGINT) AS o_d2
FROM (SELECT DISTINCT CAST((l_orderkey - l_orderkey % 25) / 25 AS BIGINT) AS case_id
  FROM lineitem) c CROSS JOIN range(8) t(id)
"""
CROP = (24, 24, 24)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight overlapping tile origins per case."""
    cases_ = (
        table(spark, sf_dir, "lineitem")
        .select(F.expr("CAST((l_orderkey - l_orderkey % 25) / 25 AS BIGINT)").alias("case_id"))
        .distinct()
    )
    return cases_.withColumn("tile_idx", F.explode(F.sequence(F.lit(0), F.lit(7)))).selectExpr(
        "case_id",
        "tile_idx",
        "CAST(tile_idx % 2 * 12 AS BIGINT) AS o_d0",
        "CAST(tile_idx DIV 2 % 2 * 12 AS BIGINT) AS o_d1",
        "CAST(tile_idx DIV 4 * 12 AS BIGINT) AS o_d2",
    )


FEATURES_SQL = """
SELECT s_suppkey AS tile_id, CAST(id // 64 AS INT) AS d0, CAST(id % 64 // 8 AS INT) AS d1,
  CAST(id % 8 AS INT) AS d2, CAST((s_suppkey * 13 + id * 29) % 97 AS DOUBLE) / 97 AS value
FROM supplier CROSS JOIN range(512) t(id)
"""
FMAP = (8, 8, 8)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 x 8 one-channel feature grid per supplier."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile_id"))
    return _grid(spread_grids(ids, prod(FMAP)), FMAP).selectExpr(
        "tile_id",
        "d0",
        "d1",
        "d2",
        "CAST((tile_id * 13 + (d0 * 64 + d1 * 8 + d2) * 29) % 97 AS DOUBLE) / 97 AS value",
    )


TILE_FEATURES_SQL = f"""
SELECT case_id, tile_idx, CAST(v // 16 AS INT) AS d0, CAST(v % 16 // 4 AS INT) AS d1,
  CAST(v % 4 AS INT) AS d2,
  CAST((case_id * 13 + tile_idx * 7 + v * 29) % 97 AS DOUBLE) / 97 AS f0,
  CAST((case_id * 5 + tile_idx * 11 + v * 31) % 89 AS DOUBLE) / 89 AS f1
FROM ({TILES_SQL}) t CROSS JOIN range(64) g(v)
"""
TILE_FMAP = (4, 4, 4)


def tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 x 4 two-channel feature grid per tile."""
    v = "(d0 * 16 + d1 * 4 + d2)"
    return _grid(spread_grids(tiles(spark, sf_dir), prod(TILE_FMAP)), TILE_FMAP).selectExpr(
        "case_id",
        "tile_idx",
        "d0",
        "d1",
        "d2",
        f"""array(CAST((case_id * 13 + tile_idx * 7 + {v} * 29) % 97 AS DOUBLE) / 97,
              CAST((case_id * 5 + tile_idx * 11 + {v} * 31) % 89 AS DOUBLE) / 89) AS features""",
    )


EMBEDDINGS_SQL = """
SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'val' END AS split, embedding, label
FROM embeddings
"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in two populations."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id",
        "CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'val' END AS split",
        "embedding",
        "label",
    )


HEADERS_SQL = """
SELECT concat('DATA_', CAST(p_partkey AS VARCHAR(12)), '.nrrd') AS path,
  CASE WHEN p_size = 1 THEN 4 ELSE 3 END AS dim,
  CASE WHEN p_size = 2 THEN NULL ELSE [p_size + 10, p_size + 20, p_size + 30] END AS sizes,
  CASE WHEN p_size = 3 THEN NULL
    WHEN p_size = 4 THEN [[1.0, 0.0], [0.0, 1.0]]
    WHEN p_size = 5 THEN [[0.5, 0.0, 0.0], [0.0, 0.5, 0.0], [0.0, 0.0, 0.5]]
    WHEN p_size = 6 THEN [[1.000005, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    ELSE [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]] END AS directions,
  CASE WHEN p_size = 7 THEN NULL WHEN p_size = 8 THEN [1.0, 0.0, 0.0]
    ELSE [0.0, 0.0, 0.0] END AS origin,
  CASE WHEN p_size = 9 THEN 'float' ELSE 'uint8' END AS dtype,
  [p_size + CASE WHEN p_size = 10 THEN 11 ELSE 10 END, p_size + 20, p_size + 30] AS shape,
  [0.3, CASE WHEN p_size = 11 THEN 0.30001 ELSE 0.3 END, CASE WHEN p_size = 12 THEN 0.4 ELSE 0.5 END]
    AS spacing
FROM part
"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume headers, most of them the placeholder and some broken in one field."""
    identity = "array(array(1D, 0D, 0D), array(0D, 1D, 0D), array(0D, 0D, 1D))"
    return table(spark, sf_dir, "part").selectExpr(
        "concat('DATA_', CAST(p_partkey AS STRING), '.nrrd') AS path",
        "CASE WHEN p_size = 1 THEN 4 ELSE 3 END AS dim",
        """CASE WHEN p_size = 2 THEN NULL ELSE
             array(p_size + 10L, p_size + 20L, p_size + 30L) END AS sizes""",
        f"""CASE WHEN p_size = 3 THEN NULL
             WHEN p_size = 4 THEN array(array(1D, 0D), array(0D, 1D))
             WHEN p_size = 5 THEN array(array(0.5D, 0D, 0D), array(0D, 0.5D, 0D), array(0D, 0D, 0.5D))
             WHEN p_size = 6 THEN array(array(1.000005D, 0D, 0D), array(0D, 1D, 0D), array(0D, 0D, 1D))
             ELSE {identity} END AS directions""",
        """CASE WHEN p_size = 7 THEN NULL WHEN p_size = 8 THEN array(1D, 0D, 0D)
             ELSE array(0D, 0D, 0D) END AS origin""",
        "CASE WHEN p_size = 9 THEN 'float' ELSE 'uint8' END AS dtype",
        """array(p_size + CASE WHEN p_size = 10 THEN 11L ELSE 10L END, p_size + 20L, p_size + 30L)
             AS shape""",
        """array(0.3D, CASE WHEN p_size = 11 THEN 0.30001D ELSE 0.3D END,
             CASE WHEN p_size = 12 THEN 0.4D ELSE 0.5D END) AS spacing""",
    )


SLOTS_SQL = f"""
SELECT case_id, fold, det_idx, score, vec_id,
  min_d0 + 0.5 AS s0, min_d1 + score AS s1, max_d0 - 30 + 10 * score AS s2, max_d1 + 0.5 AS s3,
  min_d2 - score AS s4, max_d2 + 1.5 AS s5
FROM ({PROPOSALS_SQL}) p
"""


def slot_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals as fractional detector slots; some are degenerate."""
    return proposals_flat(spark, sf_dir).selectExpr(
        "case_id",
        "fold",
        "det_idx",
        "score",
        "vec_id",
        """array(min_d0 + 0.5D, min_d1 + score, max_d0 - 30 + 10 * score, max_d1 + 0.5D,
             min_d2 - score, max_d2 + 1.5D) AS slots""",
    )


RUNS_SQL = """
SELECT c_custkey // 5 AS campaign, CAST(c_custkey % 5 AS INT) AS fold, c_custkey AS run_id,
  abs(c_acctbal) / 20 AS gpu_hours
FROM customer
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector runs with their GPU hours, five folds per campaign."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey DIV 5 AS campaign",
        "CAST(c_custkey % 5 AS INT) AS fold",
        "c_custkey AS run_id",
        "abs(c_acctbal) / 20 AS gpu_hours",
    )


SWEEP_SQL = """
SELECT CAST(user_id % 5 AS INT) AS fold, event_type AS parameter, event_id AS ordinal,
  concat('v', CAST(event_id AS VARCHAR(12))) AS label,
  CASE WHEN value < 1 THEN NULL ELSE round(value) END AS value
FROM events
"""


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep entries with many tied values and some without the metric."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id % 5 AS INT) AS fold",
        "event_type AS parameter",
        "event_id AS ordinal",
        "concat('v', CAST(event_id AS STRING)) AS label",
        "CASE WHEN value < 1 THEN NULL ELSE round(value) END AS value",
    )
