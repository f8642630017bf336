"""URL filters, in DataFrame functions only.

Each rule is indexed under the rarest of its literal tokens in the corpus. A URL's tokens fetch the candidate rules, and only those
run their regular expression.

Defined results: a null url and one without `://` have empty host and path, no rule fits, and the method allows them. Repeated
rows each get a result row. Rules of equal length: the one that sorts last. A rule without a usable literal is a candidate for every URL.
A url of any length is cut into its distinct tokens in its row and is copied to the candidate rules alone. An empty table gives an empty result; columns of the table
other than key and url play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.llm.licenses import LOWER, UPPER

TOKENS = r"[^a-zA-Z0-9]+"
#: Tokens that no URL holds: one that every row is given, and one for rules without a literal.
ROW, ANY = "\u0001row", "\u0001any"


@dataclass(frozen=True)
class Rule:
    """verdict, and either a host and path prefix (`host/path`) or a pattern with `*` for any run of characters, searched in host + path."""

    verdict: str
    text: str
    prefix: bool = True

    def regex(self) -> str:
        if self.prefix:
            return r"(?s)^(?:[^/]*\.)?" + re.escape(self.text)
        return "(?s)" + ".*".join(re.escape(x) for x in self.text.split("*"))

    def literals(self) -> list[str]:
        """Tokens that each fitting URL holds whole: those with a separator (or the host's start) on both sides."""
        text = f".{self.text}" if self.prefix else self.text
        return sorted(set(re.findall(r"(?<=[^a-zA-Z0-9*])[a-zA-Z0-9]+(?=[^a-zA-Z0-9*])", text)))


#: Rules of the contract.
BASE = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))
#: The method's own: hosts and paths that say what a page is for.
PATTERNS = tuple(Rule("block", x, False) for x in ("spam-farm.", "cheap-pills.", ".casino.", "-casino.", "/casino/", "/poker/", "/viagra/", "/wp-login.", "/cgi-bin/", "/admin/", "-porn.", ".xxx/", "/adult/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.lit(2147483647))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.lit(2147483647)), r"^([^?#]*)", 1)


def rule_table(spark: SparkSession, base: tuple[Rule, ...], patterns: tuple[Rule, ...]) -> DataFrame:
    """(id, text, verdict, is_base, regex, literals): a literal table, as long as the lists."""
    rows = [F.struct(F.lit(i).alias("id"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(i < len(base)).alias("is_base"), F.lit(r.regex()).alias("regex"),
                     F.array(*[F.lit(x) for x in r.literals() or [ANY]]).alias("literals")) for i, r in enumerate(base + patterns)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with the literal token that is rarest in `urls` (column tokens); absent tokens are the rarest, ties by text."""
    literals = rules.select(F.explode("literals").alias("token")).distinct()
    seen = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(literals), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = rules.withColumn("token", F.explode("literals")).join(seen, "token", "left")
    return each.groupBy("id", "text", "verdict", "is_base", "regex").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))


def judge(df: DataFrame, key: str, url: str, base: tuple[Rule, ...] = BASE, patterns: tuple[Rule, ...] = PATTERNS, default: str = "allow") -> DataFrame:
    """One row per row of df: key, host, path, rule, verdict, pattern. `rule` is the longest fitting base rule; without one the
    longest fitting pattern (column pattern) decides the verdict, else `default`."""
    spark = df.sparkSession
    host, path = host_and_path(F.col("u"))
    urls = df.select(F.col(key).alias("key"), F.col(url).alias("u")).select("key", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("where", F.concat("host", "path")).withColumn("tokens", F.array_distinct(F.concat(F.array(F.lit(ROW), F.lit(ANY)), F.split("where", TOKENS))))
    # the index has one row for each rule of the two lists
    rules = F.broadcast(index(urls, rule_table(spark, base, patterns)))
    c = urls.select("key", "host", "path", "where", F.explode("tokens").alias("token")).join(rules, "token", "left")
    c = c.filter((F.col("token") == ROW) | F.expr("where rlike regex"))
    fits = F.struct(F.length("text").alias("size"), F.col("text"), F.col("verdict"))
    best = c.groupBy("key", "host", "path").agg(
        F.count(F.when(F.col("token") == ROW, 1)).alias("copies"), F.max(F.when(F.col("is_base"), fits)).alias("b"), F.max(F.when(~F.col("is_base"), fits)).alias("p"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return best.select(F.col("key").alias(key), "host", "path", F.col("b.text").alias("rule"), F.coalesce("b.verdict", "p.verdict", F.lit(default)).alias("verdict"), F.col("p.text").alias("pattern"), again.alias("copy")).drop("copy")
