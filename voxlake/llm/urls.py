"""URL filters: pattern rules indexed by their rarest literal token. Column functions only.

A rule is a verdict with either a place (``host/path`` that fits the host, its subdomains and
every path that starts so) or a pattern (a regular expression over the whole URL, with the
literal tokens that any URL it fits must hold as whole tokens). Tokens are the maximal runs of
letters and digits of the lower-cased URL. Every rule is posted under the one of its tokens
that the fewest URLs hold; a URL's tokens fetch the rules posted under them and only those
run their regular expressions. Rules without a literal token are tried on every URL.

Null URLs, and URLs without ``://``, have an empty host and path, fit no place rule and get the
default verdict unless a pattern fits. Repeated rows are judged each on their own. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.common import lower_ascii

# bound on a broadcast rule table; a larger one is joined without the hint
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    place: str | None = None
    pattern: str | None = None
    tokens: tuple[str, ...] = ()

    def literal_tokens(self) -> tuple[str, ...]:
        """Tokens that every fitting URL holds whole; a path's last token may go on."""
        if self.place is None:
            return self.tokens
        host, slash, path = self.place.partition("/")
        found = re.findall(r"[a-z0-9]+", host.lower())
        ended = re.match(r".*[^A-Za-z0-9]", slash + path)
        return tuple(found + re.findall(r"[a-z0-9]+", ended[0].lower() if ended else ""))

    def parts(self) -> tuple[str, str]:
        """Regular expression of the host and start of the path, or that of the URL and none."""
        if self.place is None:
            return self.pattern or "", ""
        host, slash, path = self.place.partition("/")
        return rf"(?:^|\.){re.sub(r'([^a-z0-9-])', r'\\\1', host.lower())}\z", slash + path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(lower_ascii(url), F.lit("([a-z0-9]+)"), F.lit(1))
    )


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as rows of literals, so that no Python worker is involved."""
    rows = [
        F.struct(
            F.lit(k).alias("rule_id"),
            F.lit(r.place or r.pattern).alias("rule"),
            F.lit(r.verdict).alias("rule_verdict"),
            F.lit(r.place is not None).alias("is_place"),
            F.lit(r.parts()[0]).alias("regex"),
            F.lit(r.parts()[1]).alias("path_start"),
            F.array(*map(F.lit, r.literal_tokens())).cast("array<string>").alias("tokens"),
        )
        for k, r in enumerate(rules)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _small(df: DataFrame, rules: list[Rule]) -> DataFrame:
    size = sum(len(r.place or r.pattern or "") + 100 for r in rules)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def index_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each rule with its posting token: its literal token in the fewest URLs (null: none).

    The counts cover all URLs but only tokens of rules, so they are as many as these.
    """
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    wanted = table.select("rule_id", F.explode_outer("tokens").alias("token"))
    tokens = pages.select(F.explode(url_tokens(F.col("url"))).alias("token"))
    counts = (
        tokens.join(_small(wanted.select("token").distinct(), rules), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("rule_id")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    return table.drop("tokens").join(rarest, "rule_id")


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and the fitting pattern.

    ``rule`` is the longest fitting place, null if there is none. Then the verdict is that of
    the first fitting pattern in the order of the rules, else ``default``.

    A URL's tokens are exploded in its own task; the candidates of a URL are folded there again
    by the partial aggregate, so what is shuffled is one row per URL whatever the rules match.
    """
    index = index_rules(pages, rules)
    url = F.col("url")
    rows = pages.select("page_id", "url").withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    # a URL without tokens still has one row; the null token meets the rules without tokens
    keys = F.array_append(F.coalesce(url_tokens(url), F.array()), F.lit(None).cast("string"))
    probes = rows.withColumn("probe", F.explode(keys))
    found = probes.join(
        _small(index.withColumnRenamed("token", "posted_at"), rules),
        F.col("probe").eqNullSafe(F.col("posted_at")),
        "left",
    )
    subject = F.when(F.col("is_place"), F.col("host")).otherwise(url)
    fits = F.rlike(subject, F.col("regex")) & F.col("path").startswith(F.col("path_start"))
    length = F.when(F.col("is_place"), F.length("rule")).otherwise(0)
    won = F.struct(length.alias("length"), (-F.col("rule_id")).alias("first"), "rule", "rule_verdict")
    found = found.select("row", "page_id", "url", "host", "path", "is_place", F.when(fits, won).alias("won"))
    best = found.groupBy("row", "page_id", "url", "host", "path").agg(
        F.max(F.when(F.col("is_place"), F.col("won"))).alias("place"),
        F.max(F.when(~F.col("is_place"), F.col("won"))).alias("pattern"),
    )
    return best.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("place.rule").alias("rule"),
        F.col("pattern.rule").alias("pattern"),
        F.coalesce("place.rule_verdict", "pattern.rule_verdict", F.lit(default)).alias("verdict"),
    )
