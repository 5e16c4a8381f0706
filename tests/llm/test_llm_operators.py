"""Corpus operators next to plain versions of what they compute, on small and awkward input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from voxlake.llm import (
    components,
    decontaminate,
    neighbours,
    pieces,
    queries,
    repeats,
    secrets,
    simhash,
    suffixes,
    token_counts,
    token_file,
    toxicity,
    units,
    urls,
)
from voxlake.llm.common import scratch

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

rng = random.Random(11)
WORDS = ["alpha", "bé", "Gam", "d", "zz", "the", "don't", "we'll", "x9", "--", "　", "'r"]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = text(30_000)
COPY = text(120)
TEXTS = [
    (1, COPY),
    (2, COPY),
    (3, COPY.replace("alpha", "beta", 1)),
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, LONG),
    (8, "a" * 3_000 + "<|endoftext|>" + " " * 700),
    (9, "password=abc123secret token: x api_key='QQQQQQQQ' AKIA" + "Z9" * 12 + " " + "0a" * 20),
    (9, "password=abc123secret token: x api_key='QQQQQQQQ' AKIA" + "Z9" * 12 + " " + "0a" * 20),
    (10, "secret=token: abcdefgh TOKEN==hijklmn paſſword=abcdefgh"),
    (11, "they're 'tis we'll x'lll ▁ mark  two\u2003spaces\n\n end "),
    (None, "a row without an id"),
    (12, COPY + " and more " + LONG[:5_000]),
]
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, scan INT, spans INT, repeats INT, __r INT"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(texts=TEXTS):
    return sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_units_give_the_text_again():
    for _, t in plain():
        keys = units.cut_at_spaces(t)
        assert "".join(map(units.unit_of, keys)) == t
        assert pieces.MARK.join(["", *pieces.unit_keys(t)]) == pieces.MARK + t.replace(" ", pieces.MARK)


def fingerprint(t, words=3):
    tokens = re.findall(rb"[^\x20\x09-\x0d]+", simhash._LOWER and t.encode().translate(simhash._LOWER))
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, empty):
    want = {}
    prints = [(i, fingerprint(t)) for i, t in plain()]
    root = {p: p for _, p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    for i, p in prints:
        if i is not None:
            want[top(p)] = min(want.get(top(p), i), i)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == Counter((i, f"{p:016x}", want.get(top(p))) for i, p in prints)
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize(("bits", "radius", "parts"), [(64, 2, 4), (64, 9, 1), (128, 20, 1)])
def test_links_connect_what_all_pairs_connect(spark, bits, radius, parts):
    local = random.Random(radius)
    values = {0, (1 << bits) - 1}
    for _ in range(60):
        value = local.getrandbits(bits)
        values.add(value)
        for _ in range(local.randint(0, 9)):
            for _ in range(local.randint(1, radius + 1)):
                value ^= 1 << local.randrange(bits)
            values.add(value)
    values = sorted(values)
    frame = spark.createDataFrame([(f"{v:0{bits // 4}x}",) for v in values], "fingerprint STRING")
    edges = simhash.links(frame, radius, bits, parts)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    want = {v: v for v in values}

    def top(x):
        while want[x] != x:
            x = want[x]
        return x

    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= radius:
                want[max(top(a), top(b))] = min(top(a), top(b))
    for v in values:
        name = f"{v:0{bits // 4}x}"
        assert roots.get(name, name) == f"{top(v):0{bits // 4}x}"


def test_strips_of_a_small_size_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    local = np.random.default_rng(0)
    left, right = (local.integers(0, 1 << 12, (n, 1)).astype(np.uint64) for n in (60, 45))
    every = np.concatenate([left, right])
    edges = simhash.compare_strips(left, right, False, 1, 4)
    label = np.arange(len(every))
    for a, b in edges:
        label[label == label[b]] = label[a]
    near = np.bitwise_count(every[:, None, 0] ^ every[None, :, 0]) <= 1
    near[:60, :60] = near[60:, 60:] = False
    assert all(label[a] == label[b] for a, b in zip(*np.nonzero(near), strict=True))
    assert all(near[a, b] for a, b in edges)


def test_one_of_each_keeps_one_row_of_a_group(docs, empty):
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and ids[9] == 1 and ids[7] == 1
    assert ids[4] + ids[5] + ids[6] == 1  # no words: one group
    assert simhash.one_of_each(empty).count() == 0


def test_only_texts_similar_at_0_8_count_as_copies(spark):
    local = random.Random(8)
    texts = []
    for g in range(60):
        base = [f"w{local.randrange(10**6)}" for _ in range(local.choice([2, 6, 7, 9, 40, 120]))]
        for _ in range(6):
            words = [*base]
            for _ in range(local.randint(0, 1 + len(words) // 25)):
                words[local.randrange(len(words))] = f"w{local.randrange(10**6)}"
            texts.append(" ".join(words + [f"x{local.randrange(99)}"] * local.randint(0, 2)))
    # 1,500 texts of six words that share nothing, and a passage that all texts of a batch share
    texts += [" ".join(f"v{6 * k + i}" for i in range(6)) for k in range(1_500)]
    passage = " ".join(f"p{k}" for k in range(70))
    texts += [" ".join([passage, *(f"q{30 * k + i}" for i in range(30))]) for k in range(150)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    close = 0
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if not x.isdisjoint(y) and 5 * len(x & y) >= 4 * len(x | y):
                root[max(top(a), top(b))] = min(top(a), top(b))
                close += 5 * len(x & y) < 4.5 * len(x | y)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    stay = {r.doc_id for r in simhash.one_of_each(frame).collect()}
    assert close > 20 and stay == {top(k) for k in range(len(texts))}


RULES = [
    urls.Rule("allow", place="org/"),
    urls.Rule("block", place="example.org/es/"),
    urls.Rule("allow", place="example.org/en/1"),
    urls.Rule("block", pattern=r"[?&]sid="),
    urls.Rule("block", pattern=r"(?i)casino", tokens=("casino",)),
]


def test_url_rules(spark):
    want = {
        "https://a.example.org/es/x": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "HTTP://EXAMPLE.ORG/en/123?sid=1": ("example.org", "/en/123", "example.org/en/1", "allow"),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://org": ("org", "", None, "allow"),
        "x://org.com/es/": ("org.com", "/es/", None, "allow"),
        "x://a.com/casino?b": ("a.com", "/casino", None, "block"),
        "x://a.com/?sid=2": ("a.com", "/", None, "block"),
        "x://a b.org/": ("a b.org", "/", "org/", "allow"),
        "no url": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "x://exampleXorg/es/": ("examplexorg", "/es/", None, "allow"),
    }
    rows = [(k, u, 1) for k, u in enumerate([*want, None, None])]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, host INT")
    got = {r.page_id: r for r in urls.judge(pages, RULES).collect()}
    assert len(got) == len(rows)
    for k, u, _ in rows:
        r = got[k]
        assert (r.host, r.path, r.rule, r.verdict) == want.get(u, ("", "", None, "allow")), u
    assert urls.judge(pages.limit(0), RULES).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 40_000, dtype=np.uint64)
    assert np.array_equal(token_file.unpack(token_file.pack(ids, bits), bits, len(ids)), ids)
    image = token_file.Image(token_file.build_image([5, None], [39_990, 40_000], ids, bits))
    assert image.doc_ids == [5, None]
    assert np.array_equal(image.document(1), ids[39_990:])
    assert np.array_equal(image.span(16_000, 17_000), ids[16_000:17_000])


def test_token_files(spark, docs, empty):
    path = scratch(spark, "t")
    token_file.write_token_files(docs, path, BPE)
    library = Tokenizer.from_file(BPE)
    want, start = [], 0
    for i, t in plain():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_file.read_documents(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in got] == want
    path = scratch(spark, "t")
    token_file.write_token_files(empty, path, BPE)
    assert token_file.read_documents(spark, path).count() == 0


def base_spans(t):
    found = []
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I | re.A,
    )
    for m in assign.finditer(t):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def test_secrets_and_ledger(spark, docs, empty):
    ledger = scratch(spark, "ledger")
    found = secrets.find_secrets(docs, ledger, secrets.BASE)
    got = Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in found.collect())
    assert got == Counter((i, tuple(base_spans(t))) for i, t in plain())
    assert found.columns == [*(c for c in docs.columns if c != "spans"), "spans"] or "spans" in found.columns
    blobs = len({t for _, t in plain()})
    assert secrets.read_ledger(spark, ledger).count() == 3 * blobs
    # nothing is new the second time; a new version of one rule scans its pairs only
    secrets.update_ledger(docs, ledger, secrets.BASE)
    assert secrets.read_ledger(spark, ledger).count() == 3 * blobs
    newer = secrets.Rule("hex", 2, "[0-9a-f]{30,}", least=30)
    secrets.update_ledger(docs, ledger, (*secrets.BASE[:2], newer))
    assert secrets.read_ledger(spark, ledger).count() == 4 * blobs
    assert secrets.find_secrets(empty, scratch(spark, "ledger")).count() == 0
    cut = found.where("doc_id = 9").select(secrets.redact(F.col("text"), F.col("spans")).alias("t"))
    assert cut.first().t == "[assign] token: x [assign]' [access] [hex]"


def test_whole_keys_and_long_passwords_are_redacted(spark):
    local = random.Random(5)
    body = ["".join(local.choices("abcXYZ0189+/", k=64)) for _ in range(9)] + ["Qk9EWQ=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    password = "".join(local.choices("abcXYZ0189_-", k=300))
    made = {
        1: ("a [private_key] b", "\n".join([f"a {begin}", *body, f"{end} b"])),
        2: ("a [private_key]\n\nIt ends here.", "\n".join([f"a {begin}", *body, "", "It ends here."])),
        3: ("[private_key]\", b", f'{begin}\\n' + "\\n".join(body) + '", b'),
        4: ("[private_key]", "\r\n".join([begin, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A", "", *body])),
        5: ("[private_key]\n[private_key]\n-- no key", "\n".join([begin, *body, begin, *body, end, "-- no key"])),
        6: ("see [url_login]host/x", f"see https://{'u' * 80}:{password}@host/x"),
        7: (f"{begin[:-1]} no key", f"{begin[:-1]} no key"),
    }
    frame = spark.createDataFrame([(i, t) for i, (_, t) in made.items()], "doc_id BIGINT, text STRING")
    found = secrets.find_secrets(frame, scratch(spark, "ledger"))
    got = {r.doc_id: r.t for r in found.select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {i: want for i, (want, _) in made.items()}


def test_toxicity_learns_from_other_rows_than_it_is_measured_on(spark):
    out = queries.op5_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.8 * sum(r.toxic for r in rows)
    assert hits >= 0.9 * sum(r.predicted for r in rows)


def test_toxicity_on_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (7, 0), (None, 1), (5, None), (12, 1)], "doc_id BIGINT, toxic INT"
    )
    for some in (labels, labels.limit(0)):
        model = toxicity.fit(docs, some)
        scores = docs.select(toxicity.score(F.col("text"), model).alias("s")).collect()
        assert len(scores) == len(TEXTS) and all(0 <= r.s <= 1 for r in scores)
    assert toxicity.fit(empty, labels).weights == {}
    flags = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in flags)


def test_rows_of_one_id_are_one_row_of_the_sample(spark):
    rows = [(0, f"text {k}") for k in range(500)] + [(i, f"other {i}") for i in range(1, 9)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id BIGINT, toxic INT")
    ids = [r.doc_id for r in labels.where(~toxicity.held_out(F.col("doc_id"))).collect()]
    sample = toxicity.labelled_sample(docs, labels)
    assert 0 in ids and sample.count() == len(ids)
    assert sample.columns == ["text", "label"]


def test_label_model_finds_rates_and_discounts_copies():
    local = np.random.default_rng(1)
    y = local.random(4_000) < 0.2
    rates = [(0.7, 0.02), (0.5, 0.05), (0.6, 0.03), (0.4, 0.01)]
    votes = np.stack([np.where(y, local.random(4_000) < a, local.random(4_000) < b) for a, b in rates], 1)
    votes = np.hstack([votes, votes[:, :1], votes[:, :1]]).astype(float)  # three copies of one voter
    model = toxicity.LabelModel(anchors=0)
    posterior = model.fit(votes, np.clip(votes.mean(1), 0.05, 0.95))
    assert abs(model.prior - 0.2) < 0.05 and abs(model.toxic[1] - 0.5) < 0.1
    assert model.weight[0] < 0.5 < model.weight[1]
    assert ((posterior > 0.5) == y).mean() > 0.93


def test_neighbours(spark):
    local = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(local.normal(size=(900, 16)))]
    rows += [(1_000 + k, rows[50][1]) for k in range(20)] + [(0, rows[0][1])]
    odd = [(2_000, None), (2_050, [0.0] * 16), (2_100, [float("nan")] * 16), (2_150, [1.0, None] * 8), (None, rows[1][1]), (2_200, [1.0])]
    frame = spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id BIGINT, embedding ARRAY<DOUBLE>, score INT")
    got: dict = {}
    for r in neighbours.nearest(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    table = dict(rows)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in table.items()}
    found = 0
    queries_ = [i for i in table if i % 50 == 0]
    for q in queries_:
        best = sorted((-round(float(unit[q] @ unit[i]), 12), i) for i in table if i != q)[:5]
        found += len({i for _, i in best} & {i for i, _ in got[q]})
        assert all(abs(float(unit[q] @ unit[i]) - s) < 1e-12 for i, s in got[q])
    assert set(got) == set(queries_) and found >= 0.95 * 5 * len(queries_)
    assert [i for i, _ in got[50]] == [1_000, 1_001, 1_002, 1_003, 1_004]  # ties to smaller ids
    assert neighbours.nearest(frame.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    assert neighbours.nearest(few).count() == 2


def test_rows_of_one_id_take_no_place_of_equal_vectors(spark):
    local = np.random.default_rng(6)
    vectors = [[float(x) for x in v] for v in local.normal(size=(200, 16))]
    rows = [(7, vectors[0])] * 6 + [(i, vectors[0]) for i in range(8, 13)]
    rows += [(1_000 + 7 * k + 1, v) for k, v in enumerate(vectors[1:])]
    frame = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = neighbours.nearest(frame, every=7).where("query_id = 7").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [8, 9, 10, 11, 12]


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    ids, unit = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got: dict = {}
    for r in neighbours.nearest(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[k]
        score[k] = -2
        found += len(set(ids[np.argsort(-score)[:5]].tolist()) & got[int(ids[k])])
        total += 5
    assert found >= 0.9 * total


def test_pieces(docs, empty):
    library = SentencePieceProcessor(model_file=PIECES)
    out = docs.select("doc_id", "text", pieces.encode_decode(F.col("text"), PIECES).alias("e")).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert r.e.ids == library.encode(r.text or "") and r.e.decoded == library.decode(r.e.ids)
    assert empty.select(pieces.encode_decode(F.col("text"), PIECES)).count() == 0


def odd_texts(n=3_000):
    local = random.Random(2)
    signs = list("aB es'rvltdm'' \n\t\r  1２é中!?.…̀  _-ǅ🙂ſ\x00\x1c▁")
    return ["".join(local.choice(signs) for _ in range(local.randint(0, 40))) for _ in range(n)]


def test_encoders_on_odd_texts():
    texts = odd_texts() + ["thes" * 4_000, " ".join(["x"] * 3_000) + "  \n"]
    library = Tokenizer.from_file(BPE)
    ids = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert token_counts.TokenCounter(BPE).count(texts) == [len(i) for i in ids]
    mine = token_file.Encoder(BPE).encode(texts)
    assert [np.frombuffer(m, "<u4").tolist() for m in mine] == ids
    encoder = pieces.PieceEncoder(PIECES)
    assert [m.tolist() for m in encoder.encode(texts)] == encoder.library.encode(texts)


def test_bounded_memory_changes_no_count(monkeypatch):
    monkeypatch.setattr(token_counts, "MERGER_STATES", 50)
    monkeypatch.setattr(token_counts, "PAIRS", 20)
    texts = odd_texts(400) + [t or "" for _, t in TEXTS]
    counter = token_counts.TokenCounter(BPE)
    counter.memo.limit = 10
    library = Tokenizer.from_file(BPE)
    want = [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [counter.count([t])[0] for t in texts] == want


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(BPE)
    out = docs.select("text", token_counts.count_tokens(F.col("text"), BPE).alias("n")).collect()
    assert all(r.n == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in out)
    assert len(out) == len(TEXTS)
    assert empty.select(token_counts.count_tokens(F.col("text"), BPE)).count() == 0


def test_suffix_arrays():
    local = random.Random(3)
    for k in range(3_000):
        t = [local.randint(1, local.choice([1, 2, 4])) for _ in range(local.randint(0, 30))]
        if k % 4 == 0:
            t = [1, 2] * local.randint(0, 8) + [1] * local.randint(0, 5) + [2, 1, 2] * local.randint(0, 5)
        t.append(0)
        assert suffixes.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def removed(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        marks = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                marks[i : i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(marks))]
        out.append((hashlib.sha256(bytes(b for b, m in zip(t, marks, strict=True) if not m)).hexdigest(), spans))
    return out


def passages():
    local = random.Random(7)
    source = [" ".join(local.choice(WORDS) for _ in range(250)) for _ in range(5)]
    texts = []
    for _ in range(40):
        t = ""
        for _ in range(local.randint(1, 4)):
            p = local.choice(source)
            a = local.randint(0, len(p))
            t += "".join(local.choice("abcdef ") for _ in range(local.randint(0, 200))) + p[a : a + local.randint(100, 900)]
        texts.append(t)
    return [*texts, texts[0], texts[1], "ab" * 700, "c" * 400, "c" * 399, "d" * 401, "", None]


def test_repeats(spark, docs, empty):
    texts = passages() + [t for _, t in TEXTS]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id BIGINT, text STRING, repeats INT")
    want = removed([(t or "").encode() for t in texts], 400)
    for r in repeats.remove_repeats(frame).collect():
        got = hashlib.sha256(bytes(r.repeats.kept)).hexdigest(), [(s.start, s.end) for s in r.repeats.spans]
        assert got == want[r.doc_id], r.doc_id
    assert repeats.remove_repeats(empty).count() == 0

    def covered(hot):
        out = {}
        for r in repeats.repeated_ranges(frame, hot=hot).collect():
            out[r.t1, r.t2] = set().union(*(range(x.start, x.end) for x in r.ranges))
        return out

    assert covered(hot=1) == covered(hot=10_000)  # many contexts of one anchor: counted otherwise


def test_repeats_across_chunks(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    data = LONG.encode()[:5_000]
    seen = [w for _, lo, n, _ in repeats.contexts(data, 400) for w in range(lo, lo + n)]
    assert seen == list(range(len(data) - 399))


ITEMS = [(1, text(40)), (2, "one two three"), (3, "   "), (4, None), (None, "seven eight"), (2, "one two three"), (10, COPY)]


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_decontamination(spark, docs, empty, limit):
    bench = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id BIGINT, text STRING, n INT")
    extra = [(20, "x One, two THREE y seven-eight"), (21, ITEMS[0][1] + " " + ITEMS[0][1]), (22, text(5))]
    more = docs.union(spark.createDataFrame([(*e, "", 0, 0, 0, 0) for e in extra], SCHEMA))
    out = decontaminate.scan(more, bench, limit=limit).collect()
    assert len(out) == len(TEXTS) + len(extra)
    for r in out:
        w, marks, items = words(r.text), set(), set()
        for item, t in ITEMS:
            v = words(t)
            size = min(10, len(v))
            grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if size else set()
            for k in range(len(w) - size + 1) if size else ():
                if tuple(w[k : k + size]) in grams:
                    marks.update(range(k, k + size))
                    items.update({item} - {None})
        got = {k for run in r.scan.hits for k in range(run.start, run.end)}
        assert (r.scan.n_words, got, r.scan["items"]) == (len(w), marks, sorted(items))
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(more, bench).collect()}
    assert cut[20] == "x  y " and 21 not in cut and 1 not in cut and cut[22] == extra[2][1]
    assert decontaminate.scan(empty, bench).count() == 0
    nothing = decontaminate.scan(docs, bench.limit(0)).collect()
    assert not any(r.scan.hits for r in nothing)
