"""URL filters by host suffix and path prefix, DataFrame functions only.

Each URL is expanded into expressions: a suffix of its host's labels followed by a
prefix of its path. Only suffixes of as many labels, and prefixes of as many
characters, as some rule has are made; others can not meet a rule. Expressions
join the rules on four bytes of their SHA-256 digest; the whole digest is
compared after the join, and of the rules that are left the longest decides.

Defined results: a null URL and one without ``://`` have an empty host and path
and the default verdict; repeated rows come out as often as they came in; of
rules of one length that both fit, the one with the longer host decides, and of
equal rules with two verdicts, block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, require

ALLOW, BLOCK = "allow", "block"
RULE_COLUMNS = "host string, path string, verdict string"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]+", ""), r"^[^?#]*", 0), F.lit(""))


def _digests(df: DataFrame, expression: Column) -> DataFrame:
    return df.withColumn("_digest", F.sha2(expression, 256)).withColumn("_short", F.substring("_digest", 1, 8))


def _sizes(rules: DataFrame) -> tuple[list[int], list[int]]:
    """The label counts and path lengths that occur in the rules: two short lists."""
    row = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("paths")).first()
    return sorted(row["labels"]), sorted(row["paths"])


def expressions(urls: DataFrame, labels: list[int], paths: list[int]) -> DataFrame:
    """``urls`` (with host and path) times their expressions: _host, _path."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*map(F.lit, labels)), lambda k: k <= F.size(parts)),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, paths)), lambda k: k <= F.length("path")),
        lambda k: F.substring(F.col("path"), F.lit(1), k))
    return urls.withColumn("_host", F.explode(suffixes)).withColumn("_path", F.explode(prefixes))


def url_verdicts(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """The columns of ``pages`` and host, path, rule, verdict.

    Distinct URLs are judged once. The rules are broadcast only where their size is
    known to be small; else both sides are shuffled by the short digest.
    """
    require(pages, url_col)
    require(rules, "host", "path", "verdict")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(F.col(url_col).alias("_url")).where("_url is not null").distinct().select(
        "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    labels, paths = _sizes(rules)
    if not labels:
        judged = urls.select("_url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("found"))
    else:
        known = _digests(rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict"), F.concat("r_host", "r_path"))
        asked = _digests(expressions(urls, labels, paths), F.concat("_host", "_path")).select("_url", "_digest", "_short")
        met = asked.alias("u").join(known.alias("r"), F.col("u._short") == F.col("r._short")).where(F.col("u._digest") == F.col("r._digest"))
        rule = F.concat("r.r_host", "r.r_path")
        best = F.struct(F.length(rule), F.length("r.r_host"), (F.col("r.verdict") == BLOCK), rule.alias("rule"), F.col("r.verdict").alias("found"))
        judged = met.groupBy("u._url").agg(F.max(best).alias("b")).select("_url", "b.rule", "b.found")
    out = pages.alias("p").join(judged.alias("j"), F.col(f"p.`{url_col}`") == F.col("j._url"), "left")
    url = F.col(f"p.`{url_col}`")
    return out.select(
        *[F.col(f"p.`{c}`") for c in own], host_of(url).alias("host"), path_of(url).alias("path"),
        F.col("j.rule").alias("rule"), F.coalesce("j.found", F.lit(default)).alias("verdict"))
