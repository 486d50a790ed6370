"""URL filters: pattern rules found by their rarest literal token.

A rule is a host and a path pattern, such as `example.net/en/`: it fits its host and all
subdomains, for paths that start with the pattern, in which `*` stands for any run of characters.
A URL has many tokens (runs of letters and digits of its host and path) but fits few rules, so every
rule is filed under that one of its whole literal tokens that is rarest among the URLs. A URL looks up
its own tokens and runs the regular expressions of the rules filed there only; rules without such a
token are tried by all. Everything is DataFrame functions.

Few rules are held in a map of the expression itself, so rows don't move at all. Beyond a number of
rules, distinct URLs are joined with the index as a table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Rules up to which the index is a literal map.
MAP_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """A rule as written (`host/path`), and its verdict."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]

    @property
    def regex(self) -> str:
        """Matches host, 0x01 and path; Java syntax."""
        quote = lambda x: re.sub(r"([^A-Za-z0-9_])", r"\\\1", x)
        return "(?s)^(?:[^\\x01]*\\.)?" + quote(self.host) + "\\x01" + ".*".join(map(quote, self.path.split("*")))

    def tokens(self) -> list[str]:
        """Tokens that every fitting URL has whole: host labels, and path tokens that end within the pattern."""
        path = [t for part in self.path.split("*") for t in re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", part)]
        return sorted({t.lower() for t in re.findall(r"[A-Za-z0-9]+", self.host) + path})


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _url_tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, and the empty one, under which rules without a token are filed."""
    low = F.translate(F.concat_ws(" ", host, path), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_union(F.split(F.regexp_replace(low, "[^a-z0-9]+", " "), " "), F.array(F.lit("")))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many rows of (host, path) have each of the given tokens."""
    wanted = F.array(*[F.lit(t) for t in tokens])
    found = urls.select(F.explode(F.array_intersect(_url_tokens(F.col("host"), F.col("path")), wanted)).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in found}


def _best(fitting: Column) -> Column:
    """Of the fitting rules the longest; of equally long ones the greatest as text."""
    return F.array_max(fitting)


def filter_urls(df: DataFrame, rules: list[Rule], url_column: str = "url", default: str = "allow", map_rules: int = MAP_RULES) -> DataFrame:
    """df with host, path, rule and verdict; columns so named are replaced.

    The longest fitting rule decides; where none fits, rule is null and the verdict the default. Null
    URLs and such without `://` have empty host and path and fit no rule. Rules that are written alike
    count once, by the greater verdict.
    """
    host, path = host_and_path(F.col(f"`{url_column}`"))
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    rows = df.select(*columns, host.alias("host"), path.alias("path"))
    rules = sorted({r.rule: r for r in sorted(rules, key=lambda r: r.verdict)}.values(), key=lambda r: r.rule)
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    tokens = sorted({t for r in rules for t in r.tokens()})
    counts = token_counts(rows, tokens) if tokens else {}
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    key = F.concat_ws("\x01", F.col("host"), F.col("path"))
    if len(rules) <= map_rules:
        entry = lambda r: F.struct(F.lit(len(r.rule)).alias("length"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"))
        index = F.create_map(*[x for t, found in filed.items() for x in (F.lit(t), F.array(*map(entry, found)))])
        known = F.array(*[F.lit(t) for t in filed])
        candidates = F.flatten(F.transform(F.array_intersect(_url_tokens(F.col("host"), F.col("path")), known), lambda t: index[t]))
        best = _best(F.filter(candidates, lambda c: F.call_function("rlike", key, c["regex"])))
        out = rows.withColumn("_best", F.when(F.col("host") != "", best))
    else:
        table = rows.sparkSession.createDataFrame([(t, len(r.rule), r.rule, r.verdict, r.regex) for t, found in filed.items() for r in found], "token string, length int, rule string, verdict string, regex string")
        urls = rows.select("host", "path").where("host <> ''").distinct()
        hits = urls.withColumn("token", F.explode(_url_tokens(F.col("host"), F.col("path")))).join(shared.small(table, len(rules)), "token").where(F.call_function("rlike", key, F.col("regex")))
        best = hits.groupBy("host", "path").agg(F.max(F.struct("length", "rule", "verdict")).alias("_best"))
        out = rows.join(best, ["host", "path"], "left").select(*rows.columns, "_best")
    return out.select(*rows.columns, F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
