"""URL filtering: host and path rules, and a blocked Bloom filter of listed URLs before an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import stored

_WORDS = 8  # 64-bit words of a block; a key sets one bit in each
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Query parameters that say where a visitor came from, and do not change the page.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host and path and query without scheme, ``www.``, fragment, closing slashes and tracking parameters; parameters in order."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    parts = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit("")))


def _probe(key: Column, blocks: int) -> tuple[list[Column], list[Column]]:
    """The block of a key with the bits to choose by, and from those its mask in each word."""
    bits = F.xxhash64(F.lit("bits"), key)
    masks = [
        F.expr("shiftleft(1L, cast(shiftrightunsigned(__bits, {0}) & 63 as int))".format(6 * w)).alias(f"mask{w}") for w in range(_WORDS)
    ]
    return [bits.alias("__bits"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")], masks


def filter_blocks(listed: int, bits_per_key: int, most: int) -> int:
    """How many 512-bit blocks for so many keys, a power of two up to ``most``: the size that is broadcast never exceeds that."""
    wanted = max(1, -(-listed * bits_per_key // (64 * _WORDS)))
    return min(most, 1 << (wanted - 1).bit_length())


def possible_and_clean(pages: DataFrame, listed: DataFrame, *, key: str, bits_per_key: int = 12, most_blocks: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Pages whose ``key`` may be listed, and the others. The filter has no false negatives."""
    blocks = filter_blocks(listed.count(), bits_per_key, most_blocks)
    hashes, masks = _probe(F.col(key), blocks)
    words = [F.bit_or(f"mask{w}").alias(f"word{w}") for w in range(_WORDS)]
    bloom = listed.select("*", *hashes).select("*", *masks).groupBy("block").agg(*words)
    probed = pages.select("*", *hashes).select("*", *masks).join(F.broadcast(bloom), "block", "left")
    hit = F.coalesce(F.expr(" AND ".join(f"(word{w} & mask{w}) <> 0" for w in range(_WORDS))), F.lit(False))
    probed = probed.withColumn("__hit", hit).select(*[f"`{c}`" for c in pages.columns], "__hit")
    return probed.filter("__hit").drop("__hit"), probed.filter("NOT __hit").drop("__hit")


def rule_cases(rules: list[tuple[str, str, str]], host: str, path: str) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule (host and path together) that fits, else null. A rule fits its host and all
    subdomains when the path starts with the rule's. A few rules are one CASE expression without a join."""
    rule = verdict = F.lit(None).cast("string")
    for decided, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(decided)).otherwise(verdict)
    return rule, verdict


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    ``listed`` has a column ``url`` of URLs to block; both sides are compared in canonical form. The blocked Bloom
    filter is built by a grouped bit_or, has at most 2**18 blocks of 64 bytes whatever the list's length (a longer list
    only lets more false hits through), and so is safe to broadcast. Only possible hits are shuffled for the exact
    join. Where a rule fits it decides; elsewhere a listed URL is blocked and any other allowed.

    Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is allowed; null
    entries of the list are ignored, repeated ones count once; rows that repeat are judged each; of two rules of one length that fit, the
    later in code-point order decides, and of two equal ones the later given; empty tables give an empty result, an empty
    list blocks nothing; other columns are ignored. A very long url is matched whole, in one task.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
        F.when(_rest(F.col(url_col)).isNotNull(), canonical_url(F.col(url_col))).alias("canonical"),
    )
    keys = stored(listed.filter(_rest(F.col("url")).isNotNull()).select(canonical_url(F.col("url")).alias("canonical")).distinct())
    possible, clean = possible_and_clean(rows, keys, key="canonical")
    exact = possible.join(keys.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rule, verdict = rule_cases(rules, "host", "path")
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return exact.unionByName(clean.withColumn("listed", F.lit(False))).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed"
    )
