"""From raw documents to token ids: five stages, each one operator of ``voxlake.llm``.

A stage takes all that its predecessor kept and returns the columns of ``documents``; the last
one adds the token ids. ``run`` writes each stage's rows to the shared folder and reads them
back, so a lost executor repeats part of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import decontaminate, pieces, secrets, simhash, toxicity
from voxlake.llm.common import kept, scratch, table, unused

# a classifier and a fingerprint are not SQL; tests compare the stages with plain versions
ORACLE_SQL = None

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the classifier learns from the labels table."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model) < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: 5-word shingles of similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; those made of little else go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the kind of each secret in its place."""
    (spans,) = unused(docs, "spans")
    found = secrets.find_secrets(docs, scratch(spark, "secret-ledger"), column=spans)
    redacted = found.withColumn("text", secrets.redact(F.col("text"), F.col(spans)))
    redacted = redacted.withColumn("n_chars", F.length("text").cast("bigint"))
    return redacted.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ids, n_tokens and the text that the ids decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    (e,) = unused(docs, "encoded")
    encoded = docs.withColumn(e, pieces.encode_decode(F.col("text"), model))
    return encoded.select(
        *docs.columns,
        F.col(e)["ids"].alias("ids"),
        F.size(F.col(e)["ids"]).cast("bigint").alias("n_tokens"),
        F.col(e)["decoded"].alias("decoded"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
