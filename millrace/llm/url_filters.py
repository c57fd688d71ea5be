"""URL filters: pattern rules behind an index of their rarest literal token (operator 3).

A rule is a host and a path prefix (``net/``, ``example.org/es/``) or a pattern with ``*`` for any
characters. Its literal tokens are the runs of letters, digits and ``_`` in it that separators or
the rule's ends close on both sides. One pass over the urls counts those tokens that occur in
rules; each rule is filed under its rarest one. The tokens of the distinct urls (host and path) are joined with the filed rules, and
only the rules found there run their regular expression. A rule without such a token is filed under the empty token,
which every url has.

The join is a hash join, so a token costs one look-up however many rules there are; rules of at most BROADCAST_BYTES
are sent to all tasks, more are shuffled. What fits a distinct url is combined there, written, and joined back to its rows.

Verdicts: of the prefix rules that fit, the longest wins; of several of one length the one that sorts last, and a rule that is
listed with both verdicts blocks. Without a prefix rule, the url is blocked if a pattern rule fits, else allowed.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is
allowed; null or repeated ids are judged row by row; an empty table gives an empty result; extra
columns are ignored. Everything is DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import written

#: Prefix rules (verdict, rule).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Pattern rules that block: over the lower-cased host and the path.
PATTERNS = ["*.spam-farm.*", "spam-farm.*", "*.cheap-pills.*", "cheap-pills.*", "*casino*/*", "*/wp-login.php*", "*/cgi-bin/*", "*.onion/*"]

#: Rules are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
_SEPARATOR = r"[^a-z0-9_]"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(pattern: str) -> list[str]:
    """Literal tokens that are whole in every string that fits."""
    return [m[1] for m in re.finditer(r"(?:(?<=[^a-z0-9_*])|^)([a-z0-9_]+)(?=[^a-z0-9_*])", pattern.lower())]


def compile_rules(rules: list[tuple[str, str]], patterns: list[str]) -> list[tuple[str, str, str, int, list[str]]]:
    """(rule, verdict, regular expression over host and path, length or 0 for a pattern, tokens)."""
    out = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        out.append((rule, verdict, rf"(?s)^([^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", len(rule), _tokens(rule + "*")))
    for p in patterns:
        body = ".*".join(re.escape(x) for x in p.split("*"))
        out.append((p, "block", f"(?s)^{body}$", 0, _tokens(p)))
    return out


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(target), _SEPARATOR)))


def index(targets: DataFrame, compiled: list) -> DataFrame:
    """The rules, each with the ``token`` that it is filed under; ``targets`` has the column ``token`` with the tokens of all urls."""
    spark = targets.sparkSession
    rules = spark.createDataFrame([(k, *r) for k, r in enumerate(compiled)], "k int, rule string, verdict string, pattern string, size int, tokens array<string>")
    known = rules.select("k", F.explode("tokens").alias("token"))
    counts = targets.join(_sent(known.select("token").distinct(), compiled), "token").groupBy("token").agg(F.count("*").alias("n"))
    filed = known.join(counts, "token", "left").groupBy("k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    return rules.join(filed, "k", "left").select("rule", "verdict", "pattern", "size", F.coalesce("rarest.token", F.lit("")).alias("token"))


def _sent(rules: DataFrame, compiled: list) -> DataFrame:
    return F.broadcast(rules) if sum(len(r[0]) + len(r[2]) + sum(map(len, r[4])) for r in compiled) <= BROADCAST_BYTES else rules


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """``host``, ``path``, ``rule``, ``verdict``, ``pattern`` (the pattern rule that blocks, if any) of each url and ``n_tested``, how many rules ran."""
    compiled = compile_rules(RULES if rules is None else rules, PATTERNS if patterns is None else patterns)
    host, path = split_url(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    distinct = urls.where(F.col("host") != "").groupBy("host", "path").agg(F.count("*").alias("rows"))
    tokens = distinct.select("host", "path", F.explode(url_tokens(F.concat("host", "path"))).alias("token"))
    tested = tokens.join(_sent(written(index(tokens, compiled)), compiled), "token").withColumn("fits", F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    best = F.max(F.when(F.col("fits") & (F.col("size") > 0), F.struct("size", "rule", "verdict")))
    found = written(tested.groupBy("host", "path").agg(best.alias("best"), F.min(F.when(F.col("fits") & (F.col("size") == 0), F.col("rule"))).alias("blocks"), F.count("*").cast("int").alias("n_tested")))
    out = urls.join(found, ["host", "path"], "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("blocks").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("__id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("best").isNull(), F.col("blocks")).alias("pattern"), F.coalesce("n_tested", F.lit(0)).alias("n_tested"))
