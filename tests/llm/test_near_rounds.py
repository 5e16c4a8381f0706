"""Rounds of the near-copies stage: few for groups around one text, none for the last edges."""

import random

from voxlake.llm import components, jaccard


def test_a_group_around_one_text_comes_together_at_once(spark, monkeypatch):
    """Texts that are like the one they were edited from, but not like one another."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    texts = [" ".join([*base[:k], f"e{k}", *base[k + 1 :]]) for k in range(5, 55, 6)]
    texts += [" ".join([*base[:k], f"f{k}", *base[k + 1 :]]) for k in range(5, 55, 6)]
    docs = spark.createDataFrame([*enumerate([*texts, " ".join(base)])], "doc_id BIGINT, text STRING")
    compared = []
    linked = jaccard._Verifier.linked
    monkeypatch.setattr(
        jaccard._Verifier, "linked", lambda self, pairs: (compared.append(pairs.count()), linked(self, pairs))[1])
    groups = jaccard.copy_groups(docs).groupBy("copies").count().collect()
    assert [r["count"] for r in groups] == [len(texts) + 1]
    assert len(compared) <= 2


def test_the_last_edges_need_no_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(500)] + [("x", "y")], "a STRING, b STRING")
    rounds = []
    kept = components.kept
    monkeypatch.setattr(components, "kept", lambda df, tag: (rounds.append(tag), kept(df, tag))[1])
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert {roots[f"n{k}"] for k in range(501)} == {"n0"} and roots["x"] == roots["y"] == "x"
    assert rounds == ["edges", "names", "last-names"]
