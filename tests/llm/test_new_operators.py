"""Collocations, word-table encoding and hard negatives next to plain versions of them."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxlake.llm import collocations, negatives, queries, word_table

BPE = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(5)

# phrases ---------------------------------------------------------------------------------


def plain_phrases(rows, least=10, most=2_000):
    """The contract, word by word."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    f[lang, tuple(words[k : k + size])] += 1
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        if any(100 * b >= 50 * a for (x, w), b in found.items()
               if x == lang and len(w) > len(words) and words in (w[:2], w[1:])):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode("utf-8", "surrogatepass"), l, r))
    return sorted(
        (lang, rank, p.decode("utf-8", "surrogatepass"), -a, l, r, n[lang], -s)
        for lang, rows in out.items()
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:most], 1)
    )


def phrase_rows():
    words = ["a", "B", "é", "日本", "x.y", "new york", "new  york\tcity", "don't", "b;", "\x1c", "q\x0b"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(60)]
    return rows + [("en", None), ("en", ""), (None, None), ("xx", " \t\n,,"), ("fr", "New York " * 5_000)] + [("en", "same, text here")] * 12


def got_phrases(df, **more):
    return sorted(tuple(r) for r in collocations.mine(df, **more).collect())


@pytest.fixture(scope="module")
def phrase_docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in phrase_rows()], "lang STRING, text STRING, a INT, l INT, phrase STRING")


@pytest.fixture(scope="module")
def wanted_phrases(phrase_docs):
    return plain_phrases([(r.lang, r.text) for r in phrase_docs.collect()])


@pytest.mark.parametrize("counters", [40, 1 << 20])
def test_phrases_equal_the_plain_count(phrase_docs, wanted_phrases, counters):
    assert wanted_phrases
    assert got_phrases(phrase_docs.repartition(5), counters=counters) == wanted_phrases


def test_phrases_of_an_empty_table(phrase_docs):
    out = collocations.mine(phrase_docs.limit(0))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def test_first_phrases_only(phrase_docs, wanted_phrases):
    assert got_phrases(phrase_docs, most=3) == [r for r in wanted_phrases if r[1] <= 3]


@pytest.mark.parametrize("capacity", [5, 50, 400])
def test_whatever_occurs_often_survives(capacity):
    stream = [int(x) for x in np.random.default_rng(3).zipf(1.3, 4_000) % 700]
    true = Counter(stream)
    summary = collocations.Summary(capacity, 10)
    for k in range(0, len(stream), 90):
        summary.merge(*collocations._summed(np.array(stream[k : k + 90], np.uint64)))
    summary.settle()
    left = dict(zip(summary.grams.tolist(), summary.counts.tolist()))
    assert summary.error < 10 and all(left.get(v, 0) >= n - summary.error for v, n in true.items())
    assert {v for v, n in true.items() if n >= 10} <= left.keys()
    if capacity > len(stream) // 10:  # as many counters as the mass asks for are never passed
        assert len(left) <= capacity


def test_more_words_than_a_packed_number_holds():
    places = [np.array([5, 1, 5, 5]), np.array([1 << 40, 2, 1 << 40, 3]), np.array([7, 8, 7, 7])]
    parts, counts = collocations._counted(places, 1 << 41)
    assert sorted(zip(*(p.tolist() for p in parts), counts.tolist())) == [(1, 2, 8, 1), (5, 3, 7, 1), (5, 1 << 40, 7, 2)]


def test_products_beyond_64_bits(spark):
    row = spark.range(1).select(
        F.expr("(CAST(1000000 AS DECIMAL(19, 0)) * CAST(3000000000000 AS DECIMAL(19, 0)) * CAST(3000000000000 AS DECIMAL(19, 0))) "
               "div (CAST(3000000000001 AS DECIMAL(19, 0)) * CAST(3000000000007 AS DECIMAL(19, 0)))").alias("s"))
    assert row.first().s == 10**6 * 9 * 10**24 // (3000000000001 * 3000000000007)


# words -----------------------------------------------------------------------------------

ODD = [
    None, "", " ", "  ", " a", "a ", "a  b", "a \n b", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b.",
    "\n\n", "\nfoo\n", "they're 'tis 's", "é　b  c", "foo.\nBar baz", "\t tab", "a" * 3_000, " " * 700 + "z",
    "ab\x85 c", "﻿ x 日本語 ſ", "a  b  c", "w " * 20_000, "x\x1c y᠎ z​ q", "a \x00 b", "1 2٣ ４",
]


@pytest.fixture(scope="module")
def word_docs(spark):
    rows = [(i, t, 7, 8, 9) for i, t in enumerate(ODD)] + [(None, "a  b", 7, 8, 9), (3, " ", 7, 8, 9)] * 3
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, t1 INT, encoded INT, ids INT")


@pytest.mark.parametrize("hot", [0, 3, 1 << 20])
def test_words_give_what_the_library_gives(word_docs, hot):
    library = Tokenizer.from_file(BPE)
    out = word_table.encode_decode(word_docs, BPE, hot=hot)
    assert sorted(out.columns) == sorted(word_docs.columns)
    rows = out.collect()
    assert len(rows) == word_docs.count()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.encoded.ids, "<u4").tolist() == ids
        assert r.encoded.decoded == library.decode(ids, skip_special_tokens=False)


def test_each_distinct_word_has_one_entry(word_docs):
    words = [r.word for r in word_table.word_table(word_docs, BPE).collect()]
    assert len(words) == len(set(words))


def test_no_texts(word_docs):
    assert word_table.encode_decode(word_docs.limit(0), BPE).count() == 0


def test_decoding_is_a_join_with_the_pieces(spark):
    library = Tokenizer.from_file(BPE)
    ids = [[], None, [50256, 11, 220], library.encode("日本 é!", add_special_tokens=False).ids, [160]]
    rows = spark.createDataFrame(list(enumerate(ids)), "at INT, ids ARRAY<INT>")
    out = {r["at"]: bytes(r.decoded).decode("utf-8", "replace")
           for r in word_table.decode(rows, word_table.piece_table(spark, BPE)).collect()}
    assert out == {k: library.decode(v or [], skip_special_tokens=False) for k, v in enumerate(ids)}
    with pytest.raises(Exception, match="no piece for id"):
        word_table.decode(spark.createDataFrame([(1, [60_000])], rows.schema), word_table.piece_table(spark, BPE)).collect()


def test_words_with_one_hash_are_not_broadcast(spark):
    words = spark.createDataFrame([("a", 5), ("b", 5), ("c", 6)], "word STRING, hash BIGINT").select("hash")
    assert word_table._single(words, np.array([5, 6])).tolist() == [False, True]


def test_packed_ranks_come_back():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1])
    data, sizes = word_table.pack(values)
    back, ends = word_table.unpack(data)
    assert back.tolist() == values.tolist() and ends.tolist() == np.cumsum(sizes).tolist()
    assert word_table.unpack(np.empty(0, np.uint8))[0].tolist() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        word_table.check_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_query_of_words(spark, sf):
    rows = queries.queries()["op12_word_table"](spark, sf).collect()
    library = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


# negatives -------------------------------------------------------------------------------


def plain_negatives(rows, every=100):
    """All pairs in whole numbers."""
    taken = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        if sum(c * c for c in x) < 1 << 61:
            taken[i] = min(taken.get(i, (label, x)), (label, x))
    out = []
    for a, (label, x) in taken.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, l == label) for i, (l, y) in taken.items() if i != a)
        for s, p in [(-s, i) for s, i, same in scored if same][:5]:
            window = [(i, -t) for t, i, same in scored if not same and 80 * s <= -100 * t <= 100 * s][:5]
            out += [(a, p, rank, i, s, t) for rank, (i, t) in enumerate(window, 1)]
    return sorted(out)


def vector_rows(spread):
    r = np.random.default_rng(9)
    rows = [(int(i), [float(np.float32(c)) for c in r.normal(spread, 0.3, 9)], int(r.integers(0, 3))) for i in range(400)]
    rows += [rows[5], rows[100], (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 9, 1), (503, [0.0] * 9, 1)]
    rows += [(504, [float("inf")] * 9, 1), (505, rows[7][1], 2), (506, rows[7][1], 1), (507, rows[7][1], None), (None, rows[7][1], 1)]
    rows += [(600, [1e30] * 9, 1), (700, [0.5, 0.5], 0), (800, [], 1), (900, [0.4] * 12, 2), (-100, rows[9][1], 0), (508, [3e6] * 9, 2)]
    return rows


@pytest.mark.parametrize("spread", [0.0, 0.2, -0.5])
@pytest.mark.parametrize("strip", [60, 16_384])
def test_negatives_equal_all_pairs(spark, spread, strip):
    rows = vector_rows(spread)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, strip INT, x INT")
    got = sorted(tuple(r) for r in negatives.hard_negatives(table, strip=strip).collect())
    assert got == plain_negatives(rows) and got


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    out = negatives.hard_negatives(negatives.rotated_labels(table))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert out.count() == 0


def test_threshold_join_leaves_out_postings():
    r = np.random.default_rng(1)
    x = r.integers(-200, 200, (500, 32)) * (np.arange(32) < 6)[None] + r.integers(-2, 3, (500, 32))
    strip = negatives.Strip(x)
    q = x[:3]
    top = np.sort(q @ x.T, axis=1)[:, -4].astype(float)
    a, rows, s = strip.at_least(q, top, np.ones((3, 500), bool))
    want = {(i, j, int(v)) for i in range(3) for j, v in enumerate(q[i] @ x.T) if v >= top[i]}
    assert set(zip(a.tolist(), rows.tolist(), s.tolist())) == want
    need = (top / np.linalg.norm(q, axis=1)).min()
    assert (strip.norms[:, 4] < need).mean() > 0.9  # half of the groups have hardly a posting
