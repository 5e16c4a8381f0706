"""The pipeline next to plain versions of its stages."""

import re

import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from voxlake.llm import toxicity
from voxlake.llm.common import drop_state, kept, table, worker_state

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.lower().encode())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {()}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, SF), "stage")
        tables.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns[: len(columns)] == columns
    raw = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    clean, single, cut, redacted, encoded = tables

    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert set(clean) == {i for i, r in raw.items() if model.score(r.text) < 0.3}
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    labelled = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 0").collect()}
    assert len(toxic & set(clean)) < 0.5 * len(toxic) and labelled <= set(clean)

    sets = {i: shingles(r.text) for i, r in clean.items()}
    order = sorted(sets)
    near = {
        (a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        for k, a in enumerate(order)
        for b in order[:k]
        if sets[a] & sets[b]
    }
    assert not [p for p, j in near.items() if j >= 0.8 and set(p) <= set(single)]
    similar = {i for p, j in near.items() if j >= 0.5 for i in p}
    assert set(clean) - similar <= set(single)

    items = [
        re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())
        for r in table(spark, SF, "benchmark").collect()
    ]
    grams = {tuple(w[k : k + 10]) for w in items for k in range(len(w) - 9)}
    for i, r in cut.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", single[i].text.lower())
        hit = any(tuple(words[k : k + 10]) in grams for k in range(len(words) - 9))
        assert (r.text != single[i].text) == hit and r.n_chars == len(r.text)
    assert set(cut) <= set(single)

    assert set(redacted) == set(cut)
    for i, r in redacted.items():
        assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text) and r.n_chars == len(r.text)
        if "[" not in r.text:
            assert r.text == cut[i].text

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(encoded) == set(redacted)
    for i, r in encoded.items():
        assert r.ids == library.encode(redacted[i].text) and r.decoded == library.decode(r.ids)


def test_near_copies_from_0_8_on_go_and_no_others(spark):
    rows = table(spark, SF, "documents")
    sets = {r.doc_id: shingles(r.text) for r in rows.collect()}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    order, pairs = sorted(sets), []
    for k, a in enumerate(order):
        for b in order[:k]:
            x, y = sets[a], sets[b]
            if not x.isdisjoint(y) and 5 * len(x & y) >= 4 * len(x | y):
                pairs.append((a, b))
                root[max(top(a), top(b))] = min(top(a), top(b))
    single = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, rows, SF).collect()}
    lost = [p for p in pairs if set(p) <= single]
    unfounded = {i for i in sets if top(i) == i} - single
    print(f"{len(pairs)} pairs from 0.8 on, {len(lost)} stay; {len(unfounded)} rows dropped without such a pair")
    assert pairs and not lost and single == {top(i) for i in sets}


def test_pipeline_query_is_the_stages_together(spark):
    out = corpus_pipeline.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.select(F.min(F.size("ids") == F.col("n_tokens")).alias("ok")).first().ok


def test_a_text_is_scanned_once_and_stages_leave_no_state(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    cut = corpus_pipeline.cut_benchmark(spark, docs, "/root/testdata/sf0.001")
    assert cut._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    worker_state("test", 1, lambda: "large")
    drop_state()
    assert worker_state("test", 1, lambda: "new") == "new"
