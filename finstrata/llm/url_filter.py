"""Allow and block rules over URLs, found through each rule's rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule lists up to this many entries are broadcast; longer ones join by shuffle.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """A rule fits *host* and all its subdomains if the URL's path starts with *path*. An empty host fits any host."""

    action: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Java regular expression over host followed by path."""
        host = rf"(?:[^/]*\.)?{_quoted(self.host)}" if self.host else "[^/]*"
        return rf"(?s)^{host}" + (_quoted(self.path) if self.path else r"(?:/|\z)")

    @property
    def tokens(self) -> list[str]:
        """Tokens every fitting URL has whole: the host's labels, and path tokens closed by a separator on both sides."""
        closed = re.match(r"(?s).*[^A-Za-z0-9]", self.path)
        found = re.findall("[A-Za-z0-9]+", self.host) + re.findall("[A-Za-z0-9]+", closed[0] if closed and self.path.startswith("/") else "")
        return list(dict.fromkeys(found)) or [""]


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", s)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to each row of *df*.

    Each rule is indexed under that of its literal tokens which the fewest distinct URLs of *df* have; a URL's tokens
    fetch the rules under them, and only those run their regular expressions. The longest fitting rule wins, of
    equally long ones a block, then the greater text. Rules without a literal token are tried on every URL.

    Null URLs and URLs without ``://`` have empty host and path; a URL that no rule fits has a null rule and the
    *default* verdict. Repeated rows stay repeated. Columns of *df* named like the added ones are replaced. An empty
    table gives an empty result; no rules give the default everywhere.
    """
    spark = df.sparkSession
    base = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    if not rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda x: x)
    table = spark.createDataFrame([(i, r.action, r.text, r.pattern) for i, r in enumerate(rules)], "rule_id int, action string, rule string, pattern string")
    literal = spark.createDataFrame([(i, t) for i, r in enumerate(rules) for t in r.tokens], "rule_id int, token string")

    tokens = F.split(F.concat_ws("/", "host", "path"), "[^A-Za-z0-9]+")
    if any(r.tokens == [""] for r in rules):
        tokens = F.array_append(tokens, "")
    urls = base.select("host", "path").where((F.col("host") != "") | (F.col("path") != "")).distinct()
    by_token = urls.select("host", "path", F.explode(F.array_distinct(tokens)).alias("token"))

    spread = by_token.join(small(literal.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literal.join(spread, "token", "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m")).select("rule_id", F.col("m.token").alias("token"))
    index = table.join(rarest, "rule_id")

    fits = by_token.join(small(index), "token").where(F.expr("regexp_like(concat(host, path), pattern)"))
    order = F.struct(F.length("rule").alias("l"), (F.col("action") == "block").alias("b"), F.col("rule").alias("r"), F.col("action").alias("a"))
    best = fits.groupBy("host", "path").agg(F.max(order).alias("best"))
    return base.join(best, ["host", "path"], "left").select(
        *[c for c in base.columns if c not in ("host", "path")], "host", "path", F.col("best.r").alias("rule"),
        F.coalesce("best.a", F.lit(default)).alias("verdict"))
