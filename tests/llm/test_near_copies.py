"""Groups of near copies: links without all pairs; components; repeats of what was written."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxlake.llm import components, jaccard, pieces, secrets, simhash
from voxlake.llm.common import scratch


def edited(rng, words, share):
    return " ".join(f"{w}{rng.randint(0, 999)}" if rng.random() < share else w for w in words)


def grams(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_a_large_group_comes_together_without_all_pairs(spark, monkeypatch):
    """Rows made by the comparison grow with the texts of a group, not with their square."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    others = [" ".join(f"x{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(200)]
    # one word in eighty changes five shingles of 56: about 0.87 of two texts' shingles are shared
    texts = [edited(rng, base, 1 / 80) for _ in range(5_000)] + others
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, key INT").repartition(8)
    compared = []
    linked = jaccard._Verifier.linked
    monkeypatch.setattr(
        jaccard._Verifier, "linked", lambda self, pairs: (compared.append(pairs.count()), linked(self, pairs))[1])
    groups = jaccard.copy_groups(docs.select("doc_id", "text")).groupBy("copies").agg(F.collect_set("doc_id").alias("ids"))
    sizes = {min(r.ids): set(r.ids) for r in groups.collect()}
    distinct = len(set(texts[:5_000]))
    assert sum(compared) < 40 * distinct, compared
    # exact: compare with what links of all pairs connect, one text of each kind
    kinds = {}
    for i, t in enumerate(texts[:5_000]):
        kinds.setdefault(frozenset(grams(t)), i)
    large = max(sizes.values(), key=len)
    sets = list(kinds)
    inside = [s for s in sets if kinds[s] in large]
    outside = [s for s in sets if kinds[s] not in large]
    assert len(large) > 4_000
    assert not [1 for s in outside for t in inside if 5 * len(s & t) >= 4 * len(s | t)]
    assert all({5_000 + k} in sizes.values() for k in range(200))


def test_fingerprints_propose_and_sets_decide(spark, monkeypatch):
    """The stage compares what fingerprints propose first; wrong or missing proposals change no result."""
    rng = random.Random(5)
    rows = []
    for k in range(20):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words, "end"])), (10 * k + 2, " ".join(words[::-1]))]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id BIGINT, text STRING")
    compared, proposals = [], []
    linked, groups_of = jaccard._Verifier.linked, jaccard.copy_groups
    monkeypatch.setattr(
        jaccard._Verifier, "linked", lambda self, pairs: (compared.append(pairs.count()), linked(self, pairs))[1])
    monkeypatch.setattr(
        simhash, "copy_groups", lambda *args: (proposals.append(args[2].count()), groups_of(*args))[1])
    want = {i for i, _ in rows if i % 10 != 1} | {None}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want
    # nearly all copies are linked by fingerprints, and nothing is left to compare for these
    assert proposals == [len(rows) + 1] and compared[0] >= 15 and sum(compared[1:]) <= 20 - compared[0]
    one = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.lit(1).alias("group"))
    for groups in (one, one.limit(0), None):
        sizes = groups_of(docs, 5, groups).groupBy("copies").agg(F.collect_set("doc_id").alias("ids")).collect()
        assert sorted(len(r.ids) for r in sizes) == [0] + [1] * 20 + [2] * 20


def test_copies_of_nothing_and_of_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, None, 5), (2, "", 5), (3, "  ", 5), (4, "one two", 5), (4, "one two", 5), (5, "ONE  two", 5),
            (None, "one two three", 5), (6, long, 5), (7, long + " end", 5)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, number INT")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == [(False, 0), (True, 1), (True, 4), (True, 6)]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_a_long_chain_needs_few_rounds(spark, monkeypatch):
    order = list(range(1_000))
    random.Random(4).shuffle(order)
    for names in (range(1_000), order):
        names = list(names)
        edges = spark.createDataFrame([(names[k], names[k + 1]) for k in range(999)] + [(5_000, 5_001), (7, 7)], "a BIGINT, b BIGINT")
        rounds = []
        kept = components.kept
        monkeypatch.setattr(components, "kept", lambda df, tag: (rounds.append(tag), kept(df, tag))[1])
        roots = {r.node: r.root for r in components.components(edges).collect()}
        monkeypatch.undo()
        assert len(roots) == 1_002 and len({roots[k] for k in range(1_000)}) == 1 and roots[5_000] == roots[5_001]
        assert roots[0] in range(1_000) and rounds.count("names") <= 12
    assert components.components(edges.limit(0)).count() == 0


def test_a_pair_twice_in_the_ledger_counts_once(spark):
    docs = spark.createDataFrame([(1, "password=abc123secret and AKIA" + "Z9" * 12)], "doc_id BIGINT, text STRING")
    ledger = scratch(spark, "ledger")
    secrets.update_ledger(docs, ledger)
    once = secrets.find_secrets(docs, ledger).first().spans
    spark.read.parquet(ledger).write.mode("append").parquet(scratch(spark, "copy"))
    rows = spark.read.parquet(ledger).collect()
    spark.createDataFrame(rows, secrets.LEDGER).write.mode("append").parquet(ledger)
    assert spark.read.parquet(ledger).count() == 2 * len(rows)
    assert secrets.find_secrets(docs, ledger).first().spans == once and once


def test_every_unit_is_compared_with_the_library(monkeypatch):
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["  two  spaces ", "plain words", " lead", "trail ", "▁mark ▁▁", "   ", "a  b"]
    encoder = pieces.PieceEncoder(model)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.library.encode(text)
    # a wrong result of an odd unit does not pass
    broken = pieces.PieceEncoder(model)
    monkeypatch.setattr(broken.memo, "lookup", lambda keys: [[b"\x05\x00\x00\x00"] * len(k) for k in keys])
    with pytest.raises(ValueError, match="differ"):
        broken.encode(["x  y"])
