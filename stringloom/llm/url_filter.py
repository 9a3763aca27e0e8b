"""URL filters (9): pattern rules indexed by their rarest literal token.

Native throughout. Each rule names a host and a path prefix; it is compiled to a regular
expression and filed under that of its literal tokens which the fewest URLs hold. A URL's tokens
fetch the rules filed under them, and only those run their expression. URLs without a host take no
part in the join, and its other side is a written table, so that Spark can split a hot URL.

Cases: a null URL, or one without "://", has an empty host and path and fits no rule. Of the
rules that fit, the longest wins (ties: the smaller text). A rule with no literal token is filed
under the empty token, which every URL holds. Rows that repeat stay; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, written

PREFIX = "__url_filter_"
#: Rules are driver-side input; beyond this many the index isn't broadcast by hint.
BROADCAST_RULES = 10_000
TOKENS = "[^0-9a-z]+"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every URL it fits holds whole.

        The host is cut at dots; of the path only segments closed by a further "/" are whole.
        """
        host = [t for t in re.split(TOKENS, self.host.lower()) if t]
        closed = self.path[: self.path.rfind("/") + 1] if "/" in self.path else ""
        return host + [t for t in re.split(TOKENS, closed.lower()) if t]

    @property
    def pattern(self) -> str:
        """Over host + path. The host may have labels in front, the path may go on."""
        quoted = lambda s: re.sub(r"([^0-9A-Za-z/])", r"\\\1", s)
        return rf"^(?:[^/]*\.)?{quoted(self.host)}{quoted(self.path or '/')}" if self.path else rf"^(?:[^/]*\.)?{quoted(self.host)}(?:/|\z)"


def url_host(url: Column) -> Column:
    return fold_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def filter_urls(urls: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule (null if none fits) and verdict."""
    spark = urls.sparkSession
    host, path = PREFIX + "host", PREFIX + "path"
    parsed = urls.withColumns({host: url_host(F.col(url_col)), path: url_path(F.col(url_col))})
    distinct = parsed.select(F.col(host).alias("h"), F.col(path).alias("p")).where("h != ''").distinct()
    tokens = F.array_distinct(F.concat(F.split(F.lower(F.concat_ws("/", "h", "p")), TOKENS, -1), F.array(F.lit(""))))
    posted = distinct.select("h", "p", F.explode(tokens).alias("token"))

    listed = spark.createDataFrame([(r.text, r.verdict, r.pattern, r.tokens) for r in rules], "rule string, verdict string, pattern string, tokens array<string>")
    postings = listed.select("rule", "verdict", "pattern", F.explode(F.when(F.size("tokens") == 0, F.array(F.lit(""))).otherwise(F.array_distinct("tokens"))).alias("token"))
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda x: x)
    wanted = postings.select("token").distinct()
    seen = posted.join(small(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = postings.join(seen, "token", "left").groupBy("rule", "verdict", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))

    fits = posted.join(small(rarest), "token").where(F.expr("rlike(concat(h, p), pattern)"))
    best = fits.groupBy("h", "p").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    best = best.select(F.col("h").alias(PREFIX + "h"), F.col("p").alias(PREFIX + "p"), F.col("best.rule").alias(PREFIX + "rule"), F.col("best.verdict").alias(PREFIX + "verdict"))
    best = written(best, "rules")
    joined = parsed.where(F.col(host) != "").join(best, (F.col(host) == F.col(PREFIX + "h")) & (F.col(path) == F.col(PREFIX + "p")), "left")
    joined = joined.unionByName(parsed.where(F.col(host) == ""), allowMissingColumns=True)
    made = {"host": F.col(host), "path": F.col(path), "rule": F.col(PREFIX + "rule"), "verdict": F.coalesce(F.col(PREFIX + "verdict"), F.lit(default))}
    return joined.withColumns(made).drop(host, path, *(PREFIX + x for x in ("h", "p", "rule", "verdict")))
