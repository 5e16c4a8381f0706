"""Secret scans over a ledger of content-addressed texts.

Every text version is a blob, addressed by the SHA-256 of its UTF-8 bytes. A ledger row says
that a blob was scanned with a version of a rule, and what was found. A scan takes the blobs of
its input once each, subtracts the blob and rule-version pairs of the ledger, runs what is
left, appends it to the ledger and joins the findings back to all rows with that blob. So copies
cost nothing, a new rule version rescans, and an unchanged corpus only joins.

Spans are in code points, end exclusive. Matches of one rule are leftmost and do not overlap;
a match that fails its length is dropped after it has taken its characters. Null texts are
empty ones. Repeated rows each get the findings of their blob; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxlake.llm.common import kept, short_batches, unused, whole


# findings of up to this many bytes are broadcast to the rows
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """``needs``: lower-case strings of which a lower-cased text must hold one to be scanned."""

    kind: str
    version: int
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the three base kinds
ASSIGN = Rule(
    "assign",
    1,
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    ignore_case=True,
    group=2,
    least=6,
    needs=("password", "passwd", "secret", "token", "apikey", "api_key"),
)
ACCESS = Rule("access", 1, "AKIA[A-Z0-9]+", least=20, needs=("akia",))
# a maximal run of the class is one match, so the length may stand in the pattern
HEX = Rule("hex", 1, "[0-9a-f]{24,}", least=24)
BASE = (ASSIGN, ACCESS, HEX)

# a key block: from its BEGIN to its END, or over the base64 lines that follow if no END comes
# before the next BEGIN; line ends may be escaped, and encrypted keys have header lines
_LINE_END = r"(?:[ \t]*+(?:\r\n?|\n|\\r\\n|\\n))"
_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_LINE_END}++[ \t]*(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*"
    r"""|[A-Za-z0-9+/=]+(?=[ \t]*(?:[\r\n\\"'`]|\Z)))|[ \t]*[A-Za-z0-9+/=]{16,})*)"""
)

# credential formats beside the base kinds
ADDED = (
    Rule("private_key", 2, _KEY, needs=("private key",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyj",)),
    Rule("hub_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("url_login", 2, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@", needs=("://",)),
)
RULES = BASE + ADDED

SPAN = "STRUCT<kind: STRING, start: INT, end: INT>"
LEDGER = f"blob STRING, rule STRING, spans ARRAY<{SPAN}>"


def blob_of(text: Column) -> Column:
    return F.sha2(whole(text), 256)


def _scan_rules(rules: tuple[Rule, ...]):
    compiled = {
        r.key: (r, re.compile(r.pattern, (re.IGNORECASE if r.ignore_case else 0) | re.ASCII))
        for r in rules
    }
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    finding = pa.struct([("rule", pa.string()), ("spans", pa.list_(span))])

    @F.arrow_udf(f"ARRAY<STRUCT<rule: STRING, spans: ARRAY<{SPAN}>>>")
    def scan(texts: pa.Array, unseen: pa.Array) -> pa.Array:
        out = []
        for text, keys in zip(texts.to_pylist(), unseen.to_pylist(), strict=True):
            low = text.lower()
            findings = []
            for key in keys:
                rule, pattern = compiled[key]
                spans = []
                if not rule.needs or any(n in low for n in rule.needs):
                    for m in pattern.finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans.append({"kind": rule.kind, "start": m.start(), "end": m.end()})
                findings.append({"rule": key, "spans": spans})
            out.append(findings)
        return pa.array(out, pa.list_(finding))

    return scan


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the blobs of ``docs`` (text) with the rule versions that ``ledger`` lacks for them.

    ``ledger`` is a Parquet folder, made if there is none, on a file system that Spark writes.
    Copies of a blob meet in the map-side combine, so a text repeated in a third of the rows
    reaches its reducer once per map task.
    """
    spark = docs.sparkSession
    short_batches(spark)
    blobs = docs.select(
        blob_of(F.col("text")).alias("blob"), whole(F.col("text")).alias("text")
    ).dropDuplicates(["blob"])
    every = F.array(*(F.lit(r.key) for r in rules))
    seen = read_ledger(spark, ledger)
    if seen is None:
        unseen = blobs.withColumn("unseen", every)
    else:
        done = seen.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        unseen = (
            blobs.join(done, "blob", "left")
            .withColumn("unseen", F.array_except(every, F.coalesce("done", F.array())))
            .where(F.size("unseen") > 0)
        )
    found = unseen.select(
        "blob", F.explode(_scan_rules(rules)(F.col("text"), F.col("unseen"))).alias("f")
    )
    found.select("blob", "f.rule", "f.spans").write.mode("append").parquet(ledger)


def read_ledger(spark, ledger: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def find_secrets(
    docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, column: str = "spans"
) -> DataFrame:
    """``docs`` with ``column``: the spans of all rules, by start, then in the order of rules.

    Updates the ledger first. Only blobs with findings enter the join back.
    """
    blob, found = unused(docs, "blob", "found")
    update_ledger(docs, ledger, rules)
    rank = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    current = [r.key for r in rules]
    spans = (
        read_ledger(docs.sparkSession, ledger)
        .where(F.col("rule").isin(current) & (F.size("spans") > 0))
        # two runs at once, or one repeated after its write, leave a pair twice
        .dropDuplicates(["blob", "rule"])
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("spans")).alias("all"))
    )
    order = F.transform(
        "all",
        lambda s: F.struct(
            s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")
        ),
    )
    spans = spans.select(
        F.col("blob").alias(blob),
        F.transform(
            F.array_sort(order),
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        ).alias(found),
    )
    rows = docs.withColumn(blob, blob_of(F.col("text")))
    spans = kept(spans, "secret-findings")
    size = spans.agg((F.count("*") * 100 + F.coalesce(F.sum(F.size(found)), F.lit(0)) * 60)).first()[0]
    # few findings go to the texts; many meet them in a shuffle
    spans = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    return (
        rows.join(spans, blob, "left")
        .withColumn(column, F.coalesce(found, F.array().cast(f"ARRAY<{SPAN}>")))
        .drop(blob, found)
    )


@F.arrow_udf(StringType())
def _redacted(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text and found:
            parts, at = [], 0
            for s in found:
                if s["end"] > at:
                    if s["start"] >= at:
                        parts += (text[at : s["start"]], f"[{s['kind']}]")
                    at = s["end"]
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""
    return _redacted(text, spans)
