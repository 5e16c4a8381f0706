"""Byte-level BPE by a table of distinct words, and decoding by a table of pieces.

1. Texts are cut into words natively, at places where the pre-tokenizer always starts a token, so
   that words can be encoded one by one: before a space that has no white space beside it and, in
   texts where this is plain to see, around single line ends and before full stops and commas. The
   key of a word that begins with such a space is the rest of it; another key begins with a line
   feed instead.
2. The distinct keys are counted, and each is encoded once. Its ids are decoded by a join with the
   broadcast table of pieces (id, bytes), put together in the order of their positions. The table of
   words holds the decoded bytes only where they are not those of the word.
3. Ids and pieces come back to the texts by position. The ``hot`` most frequent words are broadcast
   (a fixed number of words of at most ``HOT_BYTES`` bytes) and found by their 64-bit hash; a word
   whose hash another word of the table has too is never among them, so this is exact. A text
   becomes the packed ranks of its words, with holes. The words of the holes are joined with the
   table by the word itself, go back to their text by position, and fill the holes there.

Copies of a text are encoded once: rows are keyed by two hashes of the text, 128 bits together.
The tokenizer must be byte-level with its usual pattern, without a normalizer and without added
tokens that hold white space or take that beside them; a string of an added token inside a text
becomes its id, as the library does by default. Null texts are empty; an empty text has no ids.
Repeated rows get equal results. Extra columns stay as they are; one with the name of the result is
replaced. Bytes that are not UTF-8 after decoding become U+FFFD.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.common import kept, short_batches, unused, whole, worker_state

#: words in the broadcast part of the table, and bytes of the longest of them
HOT = 1 << 20
HOT_BYTES = 64

# fixed values: code points with the Unicode property White_Space, as a class of Java patterns
WHITE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# some of the characters that are no white space, and some letters and digits
PLAIN = r"[!-~\x{A1}-\x{167F}]"
LETTER = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"

ENCODED = "STRUCT<ids: BINARY, decoded: STRING>"


def word_keys(text: Column) -> Column:
    """The keys of a text's words, in order; never null."""
    text = whole(text)
    # patterns start with the character they are about, as most characters fail there at once
    odd = text.rlike(rf"[ \n](?:(?<!{PLAIN}[ \n])|(?!{PLAIN}))|[.,](?<!{LETTER}[.,])")
    careful = F.split(F.concat(F.lit("\n"), text), f" (?<=[^{WHITE}] )(?=[^{WHITE}])", -1)
    marked = F.concat(F.lit("\n"), F.replace(text, F.lit("\n"), F.lit(" \n\n \n")))
    for mark in ".,":
        marked = F.replace(marked, F.lit(mark), F.lit(f" \n{mark}"))
    return F.when(odd, careful).otherwise(F.split(marked, " ", -1))


def word_of(key: str) -> str:
    return key[1:] if key[:1] == "\n" else " " + key


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def check_tokenizer(path: str) -> None:
    """Raise unless words of ``word_keys`` can be encoded one by one."""
    parts = json.loads(_tokenizer(path).to_str())
    before = parts["pre_tokenizer"] or {}
    if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
        raise ValueError("only byte-level files with the usual pre-tokens are supported")
    if parts["normalizer"] is not None:
        raise ValueError("files with a normalizer are not supported")
    for token in parts["added_tokens"]:
        bare = not (token["single_word"] or token["lstrip"] or token["rstrip"])
        if not bare or any(c.isspace() for c in token["content"]):
            raise ValueError(f"the added token {token['content']!r} reaches over word ends")


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the bytes that each id of the vocabulary stands for."""
    tokenizer = _tokenizer(path)
    # the alphabet: printable bytes stand for themselves, the others for code points from 256 on
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    byte_of = {chr(b): b for b in shown}
    byte_of.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in set(shown)))

    def piece(token: str) -> bytes:
        return bytes(map(byte_of.get, token)) if set(token) <= byte_of.keys() else token.encode()

    vocabulary = sorted((i, t) for t, i in tokenizer.get_vocab(with_added_tokens=True).items())
    table = pa.table({
        "id": pa.array([i for i, _ in vocabulary], pa.int32()),
        "piece": pa.array([piece(t) for _, t in vocabulary], pa.binary()),
    })
    return spark.createDataFrame(table)


def decode(rows: DataFrame, pieces: DataFrame, column: str = "decoded") -> DataFrame:
    """``rows`` with ``ids`` (an array) to the same with ``column``: the joined bytes of its ids.

    All other columns together name a row, so equal rows come back once. An id without a piece
    fails the job; no ids give no bytes.
    """
    at, one, piece = unused(rows, "at", "id", "piece")
    others = [c for c in rows.columns if c != column]
    named = pieces.select(F.col("id").alias("_id"), F.col("piece").alias(piece))
    tokens = rows.select(*others, F.posexplode_outer("ids").alias(at, one))
    found = tokens.join(named, F.col(one) == F.col("_id"), "left").select(
        *others,
        at,
        F.when(F.col(one).isNull() | F.col(piece).isNotNull(), F.col(piece))
        .otherwise(F.raise_error(F.concat(F.lit("no piece for id "), F.col(one).cast("string"))).cast("binary"))
        .alias(piece),
    )
    parts = F.array_sort(F.collect_list(F.when(F.col(at).isNotNull(), F.struct(at, piece))))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p[piece]))
    return found.groupBy(*others).agg(joined.alias(column))


def _joined_pieces(ids: pa.ListArray, pieces: dict[str, np.ndarray | pa.Array]) -> pa.Array:
    """The pieces of each list of ids put together: ids meet the table sorted by id."""
    offsets, values = _flat(ids)
    wanted = values.to_numpy()
    at = np.minimum(np.searchsorted(pieces["id"], wanted), len(pieces["id"]) - 1)
    lost = pieces["id"][at] != wanted
    if lost.any():
        raise ValueError(f"no piece for id {wanted[lost][0]}")
    found = pieces["piece"].take(pa.array(at))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), b"")


def word_bytes(key: Column) -> Column:
    """The bytes of a key's word."""
    own = F.when(key.startswith("\n"), F.substring(key, 2, 1 << 30)).otherwise(F.concat(F.lit(" "), key))
    return own.cast("binary")


def word_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n, ids, decoded) of each distinct key in ``docs`` (text), encoded once.

    ``decoded`` is null where it is the word itself. The rows of a word never leave the task that
    counted it: encoding and decoding need no shuffle, as the table of pieces is broadcast (as many
    rows as the vocabulary has).
    """
    spark = docs.sparkSession
    table = piece_table(spark, tokenizer).orderBy("id").toArrow()
    shared = spark.sparkContext.broadcast(
        {"id": table["id"].to_numpy(), "piece": table["piece"].combine_chunks()})

    @F.arrow_udf("STRUCT<ids: ARRAY<INT>, decoded: BINARY>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        library = worker_state("word ids", tokenizer, lambda: _tokenizer(tokenizer))
        for batch in batches:
            words = [word_of(k) for k in batch.to_pylist()]
            out = library.encode_batch_fast(words, add_special_tokens=False)
            ids = pa.array([e.ids for e in out], pa.list_(pa.int32()))
            decoded = _joined_pieces(ids, shared.value)
            same = pc.equal(decoded, pa.array([w.encode() for w in words], pa.binary()))
            decoded = pc.if_else(same, pa.scalar(None, pa.binary()), decoded)
            yield pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])

    words = docs.select(F.explode(word_keys(F.col("text"))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", "n", encode("word").alias("e")).select("word", "n", "e.ids", "e.decoded")


def _hot_words(words: DataFrame, hot: int) -> tuple[pa.Table, DataFrame]:
    """(hash, ids, decoded), most frequent first: at most ``hot`` words, all those above some count;
    and the rows of all other words."""
    short = F.octet_length("word") <= HOT_BYTES
    # counts in at most some 500 bins
    binned = words.withColumn("bin", F.floor(F.log2("n") * 8).cast("int"))
    left, lowest = hot, None
    for row in binned.where(short).groupBy("bin").count().orderBy(F.desc("bin")).collect():
        left -= row["count"]
        if left < 0:
            break
        lowest = row["bin"]
    if lowest is None:
        lowest = 1 << 30
    hashed = F.xxhash64("word").alias("hash")
    frequent = short & (F.col("bin") >= lowest)
    decoded = F.coalesce("decoded", word_bytes(F.col("word"))).alias("decoded")
    chosen = binned.where(frequent).select(hashed, "n", "ids", decoded).toArrow()
    order = np.lexsort((chosen["hash"].to_numpy(), -chosen["n"].to_numpy()))
    chosen = chosen.select(["hash", "ids", "decoded"]).take(pa.array(order))
    single = _single(words.select(hashed), chosen["hash"].to_numpy())
    # of 64-bit hashes next to none is shared
    shared = [int(h) for h in np.unique(chosen["hash"].to_numpy()[~single])]
    return chosen.filter(pa.array(single)), binned.where(~frequent | F.xxhash64("word").isin(shared)).drop("bin")


def _bytes_of(lists: pa.Array) -> pa.Array:
    """Lists of ids as little-endian 32-bit integers, one after the other."""
    offsets, values = _flat(lists)
    ends = pa.py_buffer((offsets * 4).astype(np.int32))
    data = pa.py_buffer(np.ascontiguousarray(values.to_numpy(zero_copy_only=False), "<i4"))
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, ends, data])


def _single(all_hashes: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """Mask of the hashes that stand once in ``all_hashes`` (hash), the table of all words."""
    shared = all_hashes.sparkSession.sparkContext.broadcast(np.sort(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            mine = batch.column("hash").to_numpy()
            at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
            if len(known):
                yield pa.RecordBatch.from_pydict({"hash": pa.array(mine[known[at] == mine], pa.int64())})

    hits = all_hashes.mapInArrow(run, "hash BIGINT")
    twice = hits.groupBy("hash").count().where("count > 1").select("hash").toArrow()["hash"].to_numpy()
    return ~np.isin(hashes, twice)


class HotTable:
    """Ranks of hashes (from 1), and the ids and bytes of ranks."""

    def __init__(self, hashes: np.ndarray, ids: pa.Array, decoded: pa.Array) -> None:
        order = np.argsort(hashes)
        self.sorted, self.rank = hashes[order], (order + 1).astype(np.int32)
        self.ids, self.decoded = ids, decoded

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each hash, 0 for those not in the table."""
        if not len(self.sorted):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.rank[at], 0)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**28 in one to four bytes each, the low 7 bits first, and their sizes."""
    sizes = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21)
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    first = ends - sizes
    for k in range(4):
        some = np.flatnonzero(sizes > k)
        more = (sizes[some] > k + 1).astype(np.uint8) << 7
        out[first[some] + k] = (values[some] >> 7 * k & 127).astype(np.uint8) | more
    return out, sizes


def unpack(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``pack`` and the offset after each."""
    ends = np.flatnonzero(data < 128) + 1
    if not len(ends):
        return np.empty(0, np.int64), ends
    first = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(data)) - np.repeat(first, ends - first)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first), ends


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets (from 0) and values of a list array."""
    if not len(lists):  # without rows the offsets may have no memory behind them
        return np.zeros(1, np.int32), lists.values.slice(0, 0)
    offsets = np.asarray(lists.offsets)
    return offsets - offsets[0], lists.values.slice(offsets[0], offsets[-1] - offsets[0])


def _packer(shared, version: str):
    """Hashes of a text's words to its packed ranks and the positions (from 1) of its holes."""

    @F.arrow_udf("STRUCT<packed: BINARY, holes: ARRAY<INT>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = worker_state("hot words", version, lambda: HotTable(*shared.value))
        for batch in batches:
            offsets, values = _flat(batch)
            ranks = table.ranks(values.to_numpy())
            data, sizes = pack(ranks)
            ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
            packed = pa.Array.from_buffers(
                pa.binary(), len(batch), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            at = np.flatnonzero(ranks == 0)
            ends = np.searchsorted(at, offsets)
            owner = np.repeat(offsets[:-1], np.diff(ends))
            holes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at - owner + 1, pa.int32()))
            yield pa.StructArray.from_arrays([packed, holes], ["packed", "holes"])

    return run


def _joined(values: pa.Array, words: np.ndarray) -> list[bytes]:
    """The values of consecutive words put together; ``words`` are the offsets of the texts."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = memoryview(values.buffers()[2] or b"")
    cuts = ends[words].tolist()
    return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]


def _filler(shared, version: str):
    """Packed ranks and what fills the holes, in order, to ids and decoded text."""

    @F.arrow_udf(ENCODED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = worker_state("hot words", version, lambda: HotTable(*shared.value))
        for packed, fillers in batches:
            ranks, ends = unpack(np.frombuffer(b"".join(packed.to_pylist()), np.uint8))
            sizes = np.cumsum([0, *(len(x) for x in packed.to_pylist())])
            words = np.searchsorted(ends, sizes, "right")
            _, filled = _flat(fillers)
            holes = np.flatnonzero(ranks == 0)
            if len(holes) != len(filled):
                raise ValueError("words without an entry in the table")
            index = ranks - 1
            index[holes] = len(table.ids) + np.arange(len(holes))
            index = pa.array(index)
            rare = (_bytes_of(filled.field("ids")), filled.field("decoded"))
            ids, decoded = (
                _joined(pa.concat_arrays([hot, new]).take(index), words)
                for hot, new in zip((table.ids, table.decoded), rare, strict=True)
            )
            yield pa.StructArray.from_arrays(
                [pa.array(ids, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())],
                ["ids", "decoded"],
            )

    return run


def encode_texts(docs: DataFrame, tokenizer: str, hot: int = HOT) -> DataFrame:
    """``docs`` (text) to t1, t2 (see ``text_key``), ids (little-endian 32-bit) and decoded: a row
    for each distinct text."""
    spark = docs.sparkSession
    short_batches(spark)
    check_tokenizer(tokenizer)
    words = kept(word_table(docs, tokenizer), "words")
    chosen, others = _hot_words(words, hot)
    ids, decoded = (chosen[c].combine_chunks() for c in ("ids", "decoded"))
    shared = spark.sparkContext.broadcast((chosen["hash"].to_numpy(), _bytes_of(ids), decoded))
    version = uuid.uuid4().hex
    keys = F.transform("words", lambda w: F.xxhash64(w))
    texts = docs.select(*text_key(F.col("text")), word_keys(F.col("text")).alias("words"))
    found = texts.select("t1", "t2", "words", _packer(shared, version)(keys).alias("p"))
    rare = F.transform("p.holes", lambda h: F.struct(h.alias("at"), F.element_at("words", h).alias("word")))
    # each text once; both readers of this table take it from the same shuffle
    once = (
        found.select("t1", "t2", F.struct("p.packed", rare.alias("rare")).alias("p"))
        .groupBy("t1", "t2").agg(F.first("p").alias("p"))
    )
    fillers = (
        once.select("t1", "t2", F.inline("p.rare"))
        .join(others.drop("n"), "word")
        .groupBy("t1", "t2")
        .agg(F.array_sort(F.collect_list(F.struct("at", "ids", "decoded"))).alias("fillers"))
    )
    none = F.array().cast("ARRAY<STRUCT<at: INT, ids: ARRAY<INT>, decoded: BINARY>>")

    def filler(new: Column, hole: Column) -> Column:
        own = F.coalesce(new["decoded"], word_bytes(hole["word"]))
        return F.struct(new["ids"].alias("ids"), own.alias("decoded"))

    # both lists are in the order of the positions
    filled = once.join(fillers, ["t1", "t2"], "left").select(
        "t1",
        "t2",
        _filler(shared, version)(
            F.col("p.packed"), F.zip_with(F.coalesce("fillers", none), F.col("p.rare"), filler)
        ).alias("e"),
    )
    return filled.select("t1", "t2", "e.ids", "e.decoded")


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text; null is the empty text."""
    return [F.xxhash64(whole(text)).alias("t1"), F.xxhash64(F.lit("again"), whole(text)).alias("t2")]


def encode_decode(
    docs: DataFrame, tokenizer: str, column: str = "encoded", hot: int = HOT, derive=None
) -> DataFrame:
    """``docs`` with the struct ``column``: ids (little-endian 32-bit) and decoded (text).

    ``derive`` may turn the columns ids and decoded of the distinct texts into others, by name
    (for example digests); then the struct holds these, and only they travel back to the rows.
    """
    k1, k2 = unused(docs, "t1", "t2")
    derive = derive or {"ids": F.col("ids"), "decoded": F.col("decoded")}
    texts = encode_texts(docs.select("text"), tokenizer, hot)
    texts = texts.select(
        F.col("t1").alias(k1), F.col("t2").alias(k2), F.struct(*(c.alias(n) for n, c in derive.items())).alias(column)
    )
    key = text_key(F.col("text"))
    rows = docs.drop(column).withColumns({k1: key[0], k2: key[1]})
    return rows.join(texts, [k1, k2]).drop(k1, k2)
