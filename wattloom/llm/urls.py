"""URL filter: host and path rules, and a list of canonical URLs behind a blocked Bloom filter. DataFrame functions only.

A rule ``host/path`` fits a URL if the host is the rule's or a subdomain of it and the URL's path begins with the rule's;
the longest fitting rule decides. All other URLs are blocked if their canonical form is listed. The filter has blocks of eight 64-bit words;
a URL sets one bit in each word of one block. Probing is a join on the block number, broadcast while the filter is at most
``BROADCAST_BLOCKS`` blocks (72 bytes each, 4.7 MB) and shuffled beyond. What passes is joined exactly with the list, so the filter's
false positives have no effect on the result.

Canonical form: scheme, ``www.``, fragment, trailing slash and tracking parameters dropped, host in lower case, parameters sorted.
Null URLs and those without ``://`` have empty host and path, fit no rule, are never listed and therefore allowed. Repeated pages are judged
each; an empty list blocks nothing. Other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
KEYS_PER_BLOCK, WORDS, BROADCAST_BLOCKS = 32, 8, 1 << 16
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_of(url: str | Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: str, host: Column, path: Column) -> Column:
    """The canonical form; null where the URL is null or has no host part."""
    asked = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda p: ~p.rlike(TRACKING) & (p != ""))), "&")
    plain = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))
    return F.when(F.col(url).contains("://"), F.when(kept == "", plain).otherwise(F.concat(plain, F.lit("?"), kept)))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = name.index("/")
        fits = ((host == name[:at]) | host.endswith("." + name[:at])) & path.startswith(name[at:])
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def masks(key: Column) -> list[Column]:
    """One bit for each word of a block."""
    bits = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the words of every block that has a key."""
    rows = listed.select(block_of(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks(F.col(key)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", key: str = "canonical", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed. ``listed`` holds canonical URLs in column ``key``."""
    known = stored(listed.select(F.col(key).alias("__key")).filter("__key is not null").distinct(), "listed")
    blocks = max(1, -(-known.count() // KEYS_PER_BLOCK))
    bloom = bloom_filter(known, "__key", blocks)
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom

    parts = pages.select(F.col(page_id).alias("__id"), F.col(url).alias("__url")).withColumns({"__host": host_of("__url"), "__path": path_of("__url")})
    host, path = F.col("__host"), F.col("__path")
    rule, says = rule_for(host, path, rules)
    rows = parts.select("__id", "__host", "__path", rule.alias("__rule"), says.alias("__says"), canonical("__url", host, path).alias("__key"))
    probed = rows.withColumn("block", block_of(F.col("__key"), blocks)).join(bloom, "block", "left")
    hit = [F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(masks(F.col("__key")))]
    passes = F.col("__rule").isNull() & F.col("__key").isNotNull()
    for h in hit:
        passes = passes & F.coalesce(h, F.lit(False))
    probed = probed.select("__id", "__host", "__path", "__rule", "__says", "__key", passes.alias("__maybe"))
    sure = probed.filter("__maybe").join(known.withColumn("__listed", F.lit(True)), "__key", "left")
    rest = probed.filter("not __maybe").withColumn("__listed", F.lit(False))
    both = sure.unionByName(rest)
    in_list = F.coalesce(F.col("__listed"), F.lit(False))
    return both.select(
        F.col("__id").alias(page_id), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
        F.coalesce("__says", F.when(in_list, "block").otherwise("allow")).alias("verdict"))


def captured_again(pages: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URLs that stand in several rows, the list a crawl keeps against traps and repeated captures."""
    keys = pages.select(canonical(url, host_of(url), path_of(url)).alias("canonical"))
    return keys.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and canonical is not null").select("canonical")
