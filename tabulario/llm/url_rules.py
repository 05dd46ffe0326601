"""URL filters as a sort-merge range join (operator 1).

The host of a rule, its labels reversed, and the rule's path make a canonical key; the urls that the rule fits on that
level of their host are those whose key starts with it, an interval of the sorted keys. Urls get one key for each of
their leading host levels that any rule uses. Keys and rules are dealt into slices of the key space, a rule going to
every slice that its interval meets, and each slice is swept in order with a stack of the rules that are open.
"""
from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = chr(0x10FFFF)
SAMPLES_PER_SLICE = 64


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(labels: Column, path: Column) -> Column:
    """Key of reversed host labels and a path. '#' is in neither, so a host never runs on into a longer label."""
    return F.concat(F.array_join(labels, "."), F.lit("#"), path)


def labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by slice and key, rules before urls: the innermost open rule of each url key that has one."""
    at, stack = None, []
    for batch in batches:
        found = []
        for row in batch.itertuples(index=False):
            if row.slice != at:
                at, stack = row.slice, []
            while stack and not row.key.startswith(stack[-1].key):
                stack.pop()
            if row.is_url:
                if stack:
                    found.append((row.host, row.path, stack[-1].rule, stack[-1].verdict))
            else:
                stack.append(row)
        yield pd.DataFrame(found, columns=["host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", into: str = "url_verdict") -> DataFrame:
    """Add struct column `into` (host, path, rule, verdict) to every row of `pages`; it is replaced if there.

    `rules` has columns rule (host, then its path from the first '/') and verdict ("allow" or "block"). A rule fits its
    host and all subdomains if the path starts with its own; the longest rule wins, of equally long ones that with the
    longer host. Of rules that are equal "block" wins; null rules are left out. Urls without a rule get null and
    `default`. Null and malformed urls have empty host and path, which no rule fits. Repeated rows stay.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_path(F.col(url).cast("string"))
    parsed = pages.withColumn(into, F.struct(host.alias("host"), path.alias("path")))

    rule_host = F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER)
    parts = labels(rule_host)
    wanted = rules.where(F.col("rule").isNotNull() & F.col("verdict").isin("allow", "block")).groupBy("rule").agg(
        F.max("verdict").alias("verdict")).select(  # "block" sorts after "allow"
        canonical(parts, F.substring("rule", F.length(rule_host) + F.lit(1), F.length("rule"))).alias("key"),
        "rule", "verdict", F.size(parts).alias("depth"))
    deepest = wanted.agg(F.coalesce(F.max("depth"), F.lit(0))).head()[0]

    # every host and path once, however many pages share them
    urls = parsed.select(f"{into}.host", f"{into}.path").where("host <> ''").distinct()
    own = labels(F.col("host"))
    levels = F.sequence(F.lit(1), F.least(F.size(own), F.lit(max(deepest, 1))))
    keys = urls.select("host", "path", own.alias("own"), F.explode(levels).alias("level")).select(
        "host", "path", canonical(F.slice("own", F.lit(1), F.col("level")), F.col("path")).alias("key"))
    # bounds of slices: a sample of fixed size, which only balances the slices and decides nothing
    sample = sorted(r[0] for r in keys.select("key").orderBy(F.xxhash64("key"), "key").limit(n * SAMPLES_PER_SLICE).collect())
    bounds = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []

    @pandas_udf("low int, high int")
    def slices(key: pd.Series, is_url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(low := bisect.bisect_right(bounds, k), low if u else bisect.bisect_right(bounds, k + LAST))
                             for k, u in zip(key, is_url)], columns=["low", "high"])

    none = F.lit(None).cast("string")
    both = keys.select("key", F.lit(True).alias("is_url"), "host", "path", none.alias("rule"), none.alias("verdict")).unionByName(
        wanted.select("key", F.lit(False).alias("is_url"), none.alias("host"), none.alias("path"), "rule", "verdict"))
    dealt = both.withColumn("_s", slices("key", "is_url")).select(
        F.explode(F.sequence("_s.low", "_s.high")).alias("slice"), "key", "is_url", "host", "path", "rule", "verdict")
    hits = dealt.repartition(n, "slice").sortWithinPartitions("slice", "key", "is_url").mapInPandas(
        sweep, "host string, path string, rule string, verdict string")
    rule_size = F.struct(F.length("rule"), F.length(F.regexp_extract("rule", "^[^/]*", 0)), "rule", "verdict")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rule_size).alias("_best"))

    out = parsed.join(best.withColumnsRenamed({"host": "_host", "path": "_path"}),
                      (F.col(f"{into}.host") == F.col("_host")) & (F.col(f"{into}.path") == F.col("_path")), "left")
    return out.withColumn(into, F.struct(
        F.col(f"{into}.host").alias("host"), F.col(f"{into}.path").alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))).drop("_host", "_path", "_best")


def report(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """`key`, host, path, rule and verdict of each row."""
    return judge(pages.select(F.col(key), F.col(url).alias("_url")), rules, default, "_url", "_v").select(key, "_v.*")
