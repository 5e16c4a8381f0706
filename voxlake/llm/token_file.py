"""Token ids in files of fixed-width bit-packed blocks.

A file image holds consecutive documents: a header, the document ids, the end offset of each
document, the byte offset of each block, and the blocks. A block packs ``BLOCK_IDS`` ids
(the last one fewer) of ``bits`` bits each, least significant bit first, in 64-bit
little-endian words, so that it unpacks with whole-array numpy operations. The images are
the ``image`` column of a Parquet folder: Spark writes and reads them on any file system,
and a lost task writes its images again.

Null texts are empty ones; documents without text still get the end id. Rows with the same
id are ordered by their text; null ids come first. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.llm.common import short_batches, whole, worker_state
from voxlake.llm.units import UnitMemo, cut_at_spaces, text_groups, unit_of

MAGIC = b"VXTK"
HEADER = "<4sBxxxIqqq"  # magic, bits, block ids, documents, ids, blocks
BLOCK_IDS = 16_384
IMAGE_IDS = 1 << 20
GROUP = 64  # ids whose packed form fills whole words at any width

MEMO_UNITS = 800_000

SEGMENT = "part INT, seq INT, before BIGINT, n_ids BIGINT, image BINARY"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids as 64-bit words of ``bits`` bits each; the tail is padded to a whole group."""
    rows = -(-len(ids) // GROUP)
    lanes = np.zeros((rows, GROUP), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((rows, bits), np.uint64)
    for lane in range(GROUP):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    words = words.reshape(-1, bits)
    lanes = np.empty((len(words), GROUP), np.uint64)
    for lane in range(GROUP):
        word, shift = divmod(lane * bits, 64)
        lanes[:, lane] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lanes[:, lane] |= words[:, word + 1] << np.uint64(64 - shift)
    lanes &= np.uint64((1 << bits) - 1)
    return lanes.reshape(-1)[:count].astype(np.uint32)


def build_image(doc_ids: list, ends: list[int], ids: np.ndarray, bits: int) -> bytes:
    """One file image; a missing document id is stored as a flag beside a zero."""
    blocks = [pack(ids[k : k + BLOCK_IDS], bits) for k in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *(b.nbytes for b in blocks)], dtype=np.int64)
    return b"".join(
        [
            struct.pack(
                HEADER, MAGIC, bits, BLOCK_IDS, len(doc_ids), len(ids), len(blocks)),
            np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array(ends, np.int64).tobytes(),
            offsets.tobytes(),
            *(b.tobytes() for b in blocks),
        ]
    )


class Image:
    """Random access to the documents of one file image."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, self.block_ids, docs, self.n_ids, blocks = struct.unpack_from(
            HEADER, data
        )
        if magic != MAGIC:
            raise ValueError("not a token file image")
        at = struct.calcsize(HEADER)
        ids = np.frombuffer(data, np.int64, docs, at)
        missing = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if m else int(d) for d, m in zip(ids, missing, strict=True)]
        at += 9 * docs
        self.ends = np.frombuffer(data, np.int64, docs, at)
        at += 8 * docs
        self.offsets = np.frombuffer(data, np.int64, blocks + 1, at)
        self.data, self.base = data, at + 8 * (blocks + 1)

    def block(self, k: int) -> np.ndarray:
        lo, hi = int(self.offsets[k]), int(self.offsets[k + 1])
        words = np.frombuffer(self.data, np.uint64, (hi - lo) // 8, self.base + lo)
        return unpack(words, self.bits, min(self.block_ids, self.n_ids - k * self.block_ids))

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive), unpacking only the blocks that hold them."""
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        ids = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return ids[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class Encoder:
    """Units to ids; each distinct unit goes through the tokenizers library once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        # characters of an entry stand for its bytes; added tokens hold their own text
        self.width = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(size)])
        before = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex", True):
            raise ValueError("only byte-level files with the usual pre-tokens are supported")
        self.memo = UnitMemo(self.encode_units, MEMO_UNITS)

    def encode_units(self, keys: list) -> Iterator[bytes]:
        """Little-endian 32-bit ids of units.

        Units that have no white space beside their first space are put one after the other and
        encoded as a few long texts; the widths of the ids tell where each unit ends.
        """
        joined = [
            k
            for k in keys
            if type(k) is str and k and not k[0].isspace() and not k[-1].isspace()
        ]
        found = dict(zip(joined, self.encode_joined(joined), strict=True))
        alone = [k for k in keys if k not in found]
        out = self.tokenizer.encode_batch_fast(
            [unit_of(k) for k in alone], add_special_tokens=False
        )
        found.update((k, np.array(e.ids, "<u4").tobytes()) for k, e in zip(alone, out, strict=True))
        return map(found.__getitem__, keys)

    def encode_joined(self, keys: list[str]) -> Iterator[bytes]:
        parts = [keys[k : k + 4_000] for k in range(0, len(keys), 4_000)]
        texts = [" " + " ".join(part) for part in parts]
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        for part, encoded in zip(parts, out, strict=True):
            ids = np.array(encoded.ids, "<u4")
            bytes_before = np.concatenate([[0], np.cumsum(self.width[ids])])
            ends = np.cumsum([len(k.encode("utf-8", "surrogatepass")) + 1 for k in part])
            at = np.searchsorted(bytes_before, ends)
            if not np.array_equal(bytes_before[at], ends):
                raise ValueError("an id crosses two units")
            data, lo = ids.tobytes(), 0
            for hi in (at * 4).tolist():
                yield data[lo:hi]
                lo = hi

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.memo.lookup([cut_at_spaces(t) if t else [] for t in texts])
        return [b"".join(values) for values in found]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each, write images in doc_id order.

    Texts are range-partitioned by id before they are encoded, so every image holds a range
    of ids and the order of (part, seq) is the order of ids. ``tokenizer`` is the path of a
    byte-level BPE file of the tokenizers library.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    short_batches(spark)
    bits = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"), "text"
    )
    end = np.array([end_id], "<u4").tobytes()

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state("token ids", tokenizer, lambda: Encoder(tokenizer))
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        doc_ids, ends, total = [], [], 0

        def image() -> pa.RecordBatch:
            data = build_image(doc_ids, ends, np.frombuffer(b"".join(held), "<u4"), bits)
            return pa.RecordBatch.from_pydict(
                {
                    "part": [part],
                    "seq": [seq],
                    "before": [before],
                    "n_ids": [total],
                    "image": [data],
                },
                schema=pa.schema(
                    [
                        ("part", pa.int32()),
                        ("seq", pa.int32()),
                        ("before", pa.int64()),
                        ("n_ids", pa.int64()),
                        ("image", pa.binary()),
                    ]
                ),
            )

        for batch in batches:
            ids = iter(batch.column("doc_id").to_pylist())
            for group in text_groups(batch.column("text").to_pylist()):
                for encoded in encoder.encode(group):
                    held += (encoded, end)
                    total += len(encoded) // 4 + 1
                    doc_ids.append(next(ids))
                    ends.append(total)
                    if total >= IMAGE_IDS:
                        yield image()
                        before, seq = before + total, seq + 1
                        held, doc_ids, ends, total = [], [], [], 0
        if doc_ids:
            yield image()

    ordered.mapInArrow(images, SEGMENT).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Images of ``path`` with ``first``, the number of ids in all images before each.

    An image knows the ids before it in its part; what is added is the sum of the parts before.
    There is a part for each task that wrote, so their sums are few and are broadcast.
    """
    images = spark.read.schema(SEGMENT).parquet(path)
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    joined = images.join(F.broadcast(parts), "part")
    return joined.withColumn("first", F.col("base") + F.col("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), ids.

    ``ids`` is binary: the document's ids as little-endian unsigned 32-bit integers.
    """
    short_batches(spark)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, first in zip(
                batch.column("image").to_pylist(), batch.column("first").to_pylist(), strict=True
            ):
                image = Image(data)
                ids = image.span(0, image.n_ids)
                starts = np.concatenate([[0], image.ends[:-1]])
                for k in range(0, len(starts), 1_000):
                    near = slice(k, k + 1_000)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(image.doc_ids[near], pa.int64()),
                            "start": pa.array(starts[near] + first, pa.int64()),
                            "ids": pa.array(
                                [
                                    ids[a:b].tobytes()
                                    for a, b in zip(starts[near], image.ends[near], strict=True)
                                ],
                                pa.binary(),
                            ),
                        }
                    )

    return (
        read_token_files(spark, path)
        .select("image", "first")
        .mapInArrow(documents, "doc_id BIGINT, start BIGINT, ids BINARY")
    )
