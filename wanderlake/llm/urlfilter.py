"""URL filter: a blocked Bloom filter before an exact hash join.

Entries are prefix rules (host and its subdomains, start of the path) and exact canonical URLs. A URL makes
one candidate key for every host suffix and rule-path length, and one for itself. The Bloom filter (256-bit
blocks, eight bits a key, one block a key) passes possible hits; an equi-join with the entries removes
false positives. The longest fitting rule wins; with no rule, a listed URL is blocked, any other allowed.

The filter is a table of blocks, built with bit_or and joined by block. It is broadcast while it has at most
``BROADCAST_BLOCKS`` blocks (about 40 MB) and shuffled by block beyond. Each distinct
(host, path) is judged once, so hot URLs and hosts are pre-aggregated.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and isn't
listed; repeated rows each get their verdict; of fitting rules of one length the blocking one wins; an empty
table of pages gives no rows, an empty list allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 24
BROADCAST_BLOCKS = 1_000_000
WORDS = ("w0", "w1", "w2", "w3")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without closing slashes."""
    return F.concat(host, F.regexp_replace(path, "/+$", ""))


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), host, F.lit(" "), path)


def _url_key(url: Column) -> Column:
    return F.concat(F.lit("url "), url)


def _place(df: DataFrame, blocks: int) -> DataFrame:
    """block, and the key's bits in each of the four words of it."""
    bits = F.xxhash64(F.lit(7), "key")

    def pair(i: int) -> Column:
        one = F.lit(1).cast("long")
        at = [F.shiftrightunsigned(bits, 12 * i + 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in (0, 1)]
        return F.call_function("shiftleft", one, at[0]).bitwiseOR(F.call_function("shiftleft", one, at[1]))

    out = df.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(blocks)))
    return out.withColumns({f"k{w}": pair(i) for i, w in enumerate(WORDS)})


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w3: the blocks that have any bit."""
    return _place(entries.select("key"), blocks).groupBy("block").agg(*[F.bit_or(f"k{w}").alias(w) for w in WORDS])


def possible(keys: DataFrame, blocks_table: DataFrame, blocks: int) -> DataFrame:
    """The rows of keys whose eight bits are all set."""
    small = F.broadcast(blocks_table) if blocks <= BROADCAST_BLOCKS else blocks_table
    found = _place(keys, blocks).join(small, "block")
    for w in WORDS:
        found = found.where(F.col(w).bitwiseAND(F.col(f"k{w}")) == F.col(f"k{w}"))
    return found.select(*keys.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages (page_id, url).

    rules: host, path, action (block or allow). listed: url, in canonical form.
    """
    rule_rows = rules.groupBy("host", "path").agg(F.max("action").alias("action"))
    rule_entries = rule_rows.select(_rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "action")
    url_entries = listed.where(F.col("url") != "").select("url").distinct().select(_url_key(F.col("url")).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("action"))
    entries = rule_entries.unionByName(url_entries)
    #: One number for each different length of a rule's path.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    blocks = max(1, -(-entries.count() * BITS_PER_KEY // 256))

    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    distinct = judged.where((F.col("host") != "") | (F.col("path") != "")).select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.when(F.length("path") >= n, F.substr("path", F.lit(1), F.lit(n))) for n in lengths]).cast("array<string>")
    rule_keys = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: _rule_key(h, p))))
    keys = F.array_append(F.filter(rule_keys, lambda k: k.isNotNull()), _url_key(canonical(F.col("host"), F.col("path"))))
    hits = possible(distinct.select("host", "path", F.explode(F.array_distinct(keys)).alias("key")), bloom(entries, blocks), blocks)
    exact = hits.join(entries, "key")
    best = exact.groupBy("host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "action", "rule"))).alias("won"),
        F.bool_or(F.col("rule").isNull()).alias("is_listed"),
    )
    out = judged.join(best, ["host", "path"], "left")
    is_listed = F.coalesce("is_listed", F.lit(False))
    return out.select(
        "page_id", "host", "path", F.col("won.rule").alias("rule"),
        F.coalesce(F.col("won.action"), F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        is_listed.alias("listed"),
    )
