"""URL filters as a sort-merge range join on reversed-host keys.

A rule of host and path fits the host, its subdomains, and paths that start with its own. With the labels of
the host reversed ("com.example.www."), the subdomains of a host are one interval of keys. For one path
prefix the intervals of all rules nest, so a sweep over keys and rules in order needs only a stack of active
rules: each rule brings its own stack, itself and the rules around it, and a key takes from the last stack
before it the innermost rule that still reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys under one path prefix and top-level label are swept in so many parts, each with the rules they need.
PARTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both are empty for a null url or one without '://'."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def top_label(host: Column) -> Column:
    return F.element_at(F.split(host, "\\."), -1)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """prefix, top, k (first key) and stack for every rule: an array of the rules around it, itself last.

    A host has at most 127 labels, so a stack has as many entries at most. Of rules with one host and path a
    block wins over an allow. Rules without a host fit nothing.
    """
    clean = rules.filter("host IS NOT NULL AND host <> '' AND path IS NOT NULL").groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    key = host_key(F.col("host"))
    entry = F.struct(
        F.length("host").alias("long"),
        F.regexp_replace(key, "\\.$", "/").alias("end"),  # '/' follows '.', so it ends the keys that start with this one
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    own = clean.select(F.col("host").alias("_h"), F.col("path").alias("_p"), entry.alias("entry"))
    labels = F.split("host", "\\.")
    around = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chains = clean.select("host", "path", F.explode(around).alias("_around")).join(own, (F.col("_around") == F.col("_h")) & (F.col("path") == F.col("_p")))
    stacks = chains.groupBy("host", "path").agg(F.array_sort(F.collect_list("entry")).alias("stack"))
    return stacks.select(F.col("path").alias("prefix"), top_label(F.col("host")).alias("top"), key.alias("k"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", parts: int = PARTS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (host and path of the longest rule that fits, else null) and ``verdict``.

    ``rules`` has host, path and verdict ('allow' or 'block'). Of rules that are equally long the one with the longer
    host counts. Every page keeps its row and columns; names
    that the result adds must be free. Pages meet the sweep as distinct pairs of host and path start, so a
    host with many pages is one key for each start.
    """
    taken = {"host", "path", "rule", "verdict"} & set(pages.columns)
    if taken:
        raise ValueError(f"the input has columns that the verdict adds: {sorted(taken)}")
    lengths = sorted(r["n"] for r in rules.filter("path IS NOT NULL").select(F.length("path").alias("n")).distinct().collect())
    parsed = with_host_and_path(pages, url).withColumn("_head", F.substring(F.col("path"), 1, max(lengths, default=0)))
    probes = parsed.filter("host <> ''").select("host", "_head").distinct()
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_head"))
    keys = probes.select("host", "_head", F.explode(fitting).alias("_n")).select(
        F.substr(F.col("_head"), F.lit(1), F.col("_n")).alias("prefix"),
        top_label(F.col("host")).alias("top"),
        host_key(F.col("host")).alias("k"),
        F.pmod(F.xxhash64("host", "_head"), F.lit(parts)).cast("int").alias("part"),
        "host",
        "_head",
    )
    stacks = rule_stacks(rules).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    swept = keys.unionByName(stacks, allowMissingColumns=True)
    order = Window.partitionBy("prefix", "top", "part").orderBy(F.col("k"), F.col("stack").isNull())
    last = F.last("stack", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    active = F.element_at(F.filter("_stack", lambda x: x["end"] > F.col("k")), -1)
    hits = swept.withColumn("_stack", last).filter("host IS NOT NULL").withColumn("_hit", F.when(F.exists("_stack", lambda x: x["end"] > F.col("k")), active))
    best = hits.filter("_hit IS NOT NULL").groupBy("host", "_head").agg(F.max_by(F.struct(F.col("_hit.rule"), F.col("_hit.verdict")), F.struct(F.length("_hit.rule"), F.col("_hit.long"))).alias("_best"))
    best = best.select(F.col("host").alias("_bh"), F.col("_head").alias("_bp"), "_best")
    judged = parsed.join(best, (F.col("host") == F.col("_bh")) & (F.col("_head") == F.col("_bp")), "left")
    return judged.select(
        *[F.col(f"`{c}`") for c in pages.columns], "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")
    )
