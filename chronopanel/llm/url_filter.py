"""URL block and allow lists, by hashed expressions.

A rule is a host and a path prefix. A url is expanded into host suffixes (cut at dots) times path
prefixes (cut at slashes); every expression is hashed, and only the first 32 bits of the digest are
joined with the rules. The full digest and the rest of the rule's path are confirmed after the join,
then the longest rule wins. Which depths are expanded comes from the rules, so none can be missed.

Scale: expressions are built once for each distinct (host, path), so a popular page is one row before
the join; the verdicts go back by a left join on (host, path), whose hot keys Spark may split. The rule
table is broadcast only if Spark knows it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower

#: hex digits of the digest that are joined on
PREFIX_DIGITS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url. Null, or without ``://``: both are empty."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def compile_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (rule string such as ``example.net/en/``, verdict string) with their hashes. Rules without
    a host, or with a null, are left out. A rule without a slash fits every path."""
    r = rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("verdict")).na.drop().distinct()
    cut = F.instr("rule", "/")
    r = r.withColumn("rule_host", ascii_lower(F.when(cut > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule"))))
    r = r.withColumn("rule_path", F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))).where("rule_host <> ''")
    r = r.withColumn("slashes", F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/"))))
    r = r.withColumn("labels", F.length("rule_host") - F.length(F.replace("rule_host", F.lit("."))) + 1)
    head = F.expr("if(slashes = 0, '', concat(substring_index(rule_path, '/', cast(slashes as int)), '/'))")
    r = r.withColumn("digest", F.sha2(F.concat("rule_host", head), 256))
    return r.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: the columns ``keep``, host, path, rule (null: none fits), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule
    wins; of equally long ones that with the longer host, then block. A url that no rule fits (a null or
    malformed one, or an empty path where rules name "/") gets ``default``. Null ids and repeated rows stay
    as they are; an empty table gives an empty table; other columns of ``pages`` are not looked at."""
    r = compile_rules(rules)
    depths = r.agg(F.sort_array(F.collect_set("labels")).alias("l"), F.sort_array(F.collect_set("slashes")).alias("s")).first()
    host, path = url_parts(F.col(url).cast("string"))
    parts = pages.select(*[F.col(k) for k in keep], host.alias("host"), path.alias("path"))
    suffixes = [F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -int(n))) for n in depths["l"]]
    heads = [F.lit("") if n == 0 else F.when(F.length("path") - F.length(F.replace("path", F.lit("/"))) >= n, F.concat(F.substring_index("path", "/", int(n)), F.lit("/")))
             for n in depths["s"]]
    expressions = [F.sha2(F.concat(s, h), 256) for s in suffixes for h in heads] or [F.lit(None).cast("string")]
    keys = parts.select("host", "path").distinct().where("host <> ''")
    found = (keys.withColumn("url_digest", F.explode(F.array_compact(F.array(*expressions))))
             .withColumn("prefix", F.substring("url_digest", 1, PREFIX_DIGITS))
             .join(r, "prefix").where("url_digest = digest AND startswith(path, rule_path)"))
    rank = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), (F.col("verdict") == "block").alias("b"), F.col("rule"), F.col("verdict"))
    best = found.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
