"""URL filters: longest matching rule of (host, path), by a blocked Bloom filter and an exact hash join.

A rule fits its host and all subdomains if the URL's path starts with the rule's. Every (host
suffix, path prefix) of a URL is a possible key; a Bloom filter of listed keys (64-bit blocks, as many as the
rules ask for, broadcast up to a size) passes possible hits, and a hash join on the keys removes false
positives. Only possible hits are shuffled, and only DataFrame functions are used.

Defined cases. A null URL, or one without ://, has empty host and path; only a rule with empty host
could fit it, and there is none. Of two rules with the same key, block wins. Rules whose path isn't
empty and doesn't start with / never fit. Repeated rows are judged alike and all returned; null
page_ids are kept. Further columns are ignored. An empty table gives an empty result; without rules
every verdict is the default, allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The filter's 64-bit blocks: at least so many, and a power of two with so many keys a block at most. Up to a number they are broadcast (16 bytes each).
LEAST_BLOCKS, KEYS_PER_BLOCK, BROADCAST_BLOCKS = 1 << 10, 4, 1 << 21
DEFAULT = "allow"
#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """Four bits of a key's block."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def filter_urls(pages: DataFrame, rules: DataFrame, *, blocks: int | None = None, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict. rules: host, path, verdict. blocks: of the filter, else from the number of rules."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict").filter("h <> '' and (p = '' or startswith(p, '/'))")
    rules = rules.groupBy(F.concat("h", "p").alias("key"), F.length("p").alias("size")).agg(F.max("verdict").alias("verdict"))
    lengths = rules.groupBy("size").count().collect()  # at most as many as the longest path has characters
    sizes = sorted(r["size"] for r in lengths)
    blocks = blocks or max(LEAST_BLOCKS, 1 << (sum(r["count"] for r in lengths) // KEYS_PER_BLOCK).bit_length())
    bloom = rules.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))
    if blocks <= BROADCAST_BLOCKS:  # a row has 16 bytes
        bloom = F.broadcast(bloom)

    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sizes]), lambda x: x.isNotNull()) if sizes else F.array().cast("array<string>")
    keys = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))
    tried = base.filter("host <> ''").select("host", "path", F.explode(keys).alias("key"))
    tried = tried.withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block").filter(_mask(F.col("key")).bitwiseAND(F.col("bits")) == _mask(F.col("key")))
    # possible hits only; the verdict of a host and path is the same on every page, so repeated ones meet before the shuffle
    hits = tried.join(rules, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("length"), "key", "verdict")).alias("best"))
    hits = hits.select(F.col("host").alias("hit_host"), F.col("path").alias("hit_path"), "best")
    out = base.join(hits, (F.col("host") == F.col("hit_host")) & (F.col("path") == F.col("hit_path")), "left")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP9_SQL = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), '{DEFAULT}') AS verdict
FROM u
"""
