"""One query per operator over its whole table, and the pipeline; SQL where it can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import (
    collocations,
    decontaminate,
    negatives,
    neighbours,
    pieces,
    repeats,
    secrets,
    simhash,
    token_counts,
    token_file,
    toxicity,
    urls,
    word_table,
)
from voxlake.llm.common import scratch, table, whole
from voxlake.workload.registry import Registry

REGISTRY = Registry()

# production rules of the URL filter: places first, then patterns
URL_RULES = [
    urls.Rule("allow", place="org/"),
    urls.Rule("block", place="example.org/es/"),
    urls.Rule("block", place="example.org/en/1"),
    urls.Rule("allow", place="com/fr/"),
    urls.Rule("block", place="com/de/"),
    *(
        urls.Rule("block", pattern=rf"(?i)(?<![a-z0-9]){word}(?![a-z0-9])", tokens=(word,))
        for word in ("casino", "poker", "porn", "xxx", "torrent", "viagra", "payday", "warez")
    ),
    urls.Rule("block", pattern=r"(?i)[?&](?:phpsessid|jsessionid|sessionid)="),
    urls.Rule("block", pattern=r"(?i)/wp-login\.php(?:[?#]|$)", tokens=("wp", "login", "php")),
    urls.Rule("block", pattern=r"(?i)^https?://(?:ads|adserver|doubleclick)\d*\."),
]


@REGISTRY.query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id")


@REGISTRY.query(
    "op2_url_filter",
    r"""
WITH u AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('allow', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), won AS (
  SELECT u.*, (SELECT max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM r
    WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)) AS w
  FROM u
)
SELECT page_id, host, path, w.rule AS rule, coalesce(w.verdict, CASE WHEN
    regexp_matches(url, '(?i)(^|[^a-z0-9])(casino|poker|porn|xxx|torrent|viagra|payday|warez)([^a-z0-9]|$)')
    OR regexp_matches(url, '(?i)[?&](phpsessid|jsessionid|sessionid)=')
    OR regexp_matches(url, '(?i)/wp-login\.php([?#]|$)')
    OR regexp_matches(url, '(?i)^https?://(ads|adserver|doubleclick)\d*\.')
  THEN 'block' ELSE 'allow' END) AS verdict
FROM won
""",
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@REGISTRY.query("op3_token_file")
def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    token_file.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_file.read_documents(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def _named(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _of_kinds(kinds):
    return F.filter("spans", lambda s: s["kind"].isin(kinds))


@REGISTRY.query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, scratch(spark, "secret-ledger"))
    kinds = [r.kind for r in secrets.BASE]
    return found.select(
        "doc_id",
        *(F.size(_of_kinds([k])).cast("bigint").alias(f"n_{k}") for k in kinds),
        F.sha2(_named(_of_kinds(kinds)), 256).alias("base_sha256"),
        _named(F.col("spans")).alias("spans"),
    )


@REGISTRY.query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        toxicity.score(F.col("text"), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@REGISTRY.query("op6_permutation_index")
def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@REGISTRY.query("op7_pieces")
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = docs.select("doc_id", pieces.encode_decode(F.col("text"), model).alias("e"))
    return encoded.select(
        "doc_id",
        F.size("e.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("e.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("e.decoded", 256).alias("decoded_sha256"),
    )


@REGISTRY.query("op8_repeats")
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.octet_length(whole(F.col("text"))).cast("bigint")
    return repeats.remove_repeats(docs).select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("repeats.kept")).alias("n_removed"),
        F.size("repeats.spans").cast("bigint").alias("n_spans"),
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )


@REGISTRY.query("op9_token_count")
def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    counted = token_counts.count_tokens(text, public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select(
        "doc_id",
        F.octet_length(whole(text)).cast("bigint").alias("n_bytes"),
        counted.alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > 512)


@REGISTRY.query(
    "op10_decontaminate",
    """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, least(10, len(w)) AS n, w FROM (
    SELECT item_id,
      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT k, i, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
covered AS (
  SELECT k, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY k
), named AS (
  SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY k
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN named USING (k)
""",
)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words(F.col("scan"))
    named = F.array_join(F.array_sort(F.col("scan.items").cast("array<string>")), ",")
    return scanned.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("scan.items").cast("bigint").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@REGISTRY.query(
    "op11_collocations",
    """
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS g, count(*) AS a
  FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS v(s) WHERE len(w) >= s)
  GROUP BY ALL
), c AS (
  SELECT lang, g AS phrase, s, a, k, array_to_string(string_split(g, ' ')[1 : k], ' ') AS left_part,
    array_to_string(string_split(g, ' ')[k + 1 : s], ' ') AS right_part
  FROM (SELECT *, unnest(range(1, s)) AS k FROM f WHERE s > 1 AND a >= 10)
), cut AS (
  SELECT c.lang, phrase, c.s, c.a, k, x.a AS l, y.a AS r,
    (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.g = left_part JOIN f y ON y.lang = c.lang AND y.g = right_part
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, g, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(string_split(g, ' ')[1 : 2], ' '),
      array_to_string(string_split(g, ' ')[2 : 3], ' ')]) AS g FROM f WHERE s = 3 AND a >= 10)
  GROUP BY ALL
), left_over AS (
  SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.g = phrase
  WHERE longer.a IS NULL OR 100 * longer.a < 50 * best.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score::BIGINT AS score
FROM left_over JOIN totals USING (lang)
QUALIFY rank <= 2000
""",
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@REGISTRY.query("op12_word_table")
def op12_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = {
        "n_tokens": (F.octet_length("ids") / 4).cast("bigint"),
        "ids_sha256": F.sha2("ids", 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }
    path = public_tokenizers.path("byte_bpe_50k.json")
    return word_table.encode_decode(docs, path, derive=digests).select("doc_id", "encoded.*")


@REGISTRY.query(
    "op13_hard_negatives",
    """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""",
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.rotated_labels(table(spark, sf_dir, "embeddings")))


def queries():
    return dict(REGISTRY.queries)


def oracle_sql() -> dict[str, str]:
    return {name: body.strip() for name, body in REGISTRY.bodies.items()}
