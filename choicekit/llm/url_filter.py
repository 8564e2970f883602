"""URL filters (operator 4), DataFrame functions only.

Rules decide by host and path, the longest that fits.  Other urls are blocked when their
canonical form is listed: a blocked Bloom filter of the list (one 64-bit block per hash,
``BITS`` bits set in it) lets possible hits through to an exact join with the list, which
removes the false positives.  The filter has at most ``MAX_BLOCKS`` rows of two longs,
so it may be broadcast; a longer list only lets more urls reach the join.

Defined results: a null url or one without ``://`` has empty host and path and no
canonical form, so no rule fits it and it is allowed; repeated rows are judged alike;
an empty list blocks nothing; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 6
MAX_BLOCKS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# query parameters that don't change the page
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"),
         Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"),
         Rule("net", "/fr/", "block"))


def host_of(url) -> F.Column:
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, UPPER, LOWER)


def path_of(url) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url) -> F.Column:
    """Host without www., path without a closing slash or index page, sorted query without
    tracking parameters, no fragment; null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(
        F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def matched(host, path, rules=RULES) -> F.Column:
    """(length, rule, verdict) of the longest rule that fits; null fields if none does."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                   F.struct(F.lit(len(r.text)).alias("len"), F.lit(r.text).alias("rule"),
                            F.lit(r.verdict).alias("verdict"))) for r in rules]
    none = F.lit(None).cast("struct<len:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(none, *fits)))


def _mask(h) -> F.Column:
    """BITS bits of a 64-bit block, each from six other bits of the hash."""
    one = F.lit(1).cast("long")
    bit = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 64 - 6 * (i + 1))
                           .bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    out = bit[0]
    for b in bit[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom(listed: DataFrame, blocks: int = MAX_BLOCKS) -> DataFrame:
    """(block, bits) of the canonical urls in column ``canon``."""
    h = F.xxhash64("canon")
    return listed.select(F.pmod(h, F.lit(blocks)).alias("block"), _mask(h).alias("m")) \
        .groupBy("block").agg(F.bit_or("m").alias("bits"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int = MAX_BLOCKS) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict, and listed: whether the
    canonical url is one of column ``canon`` of ``listed``."""
    listed = listed.select("canon").where("canon IS NOT NULL").distinct()
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"),
                     path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canon"))
    h = F.xxhash64("canon")
    p = p.withColumn("block", F.pmod(h, F.lit(blocks))) \
        .join(F.broadcast(bloom(listed, blocks)), "block", "left")
    maybe = F.col("canon").isNotNull() & (
        _mask(h).bitwiseAND(F.coalesce("bits", F.lit(0).cast("long"))) == _mask(h))
    hits = p.where(maybe).join(listed.withColumn("hit", F.lit(1)), "canon", "left")
    rest = p.where(~maybe).withColumn("hit", F.lit(None).cast("int"))
    both = hits.unionByName(rest).withColumn("m", matched(F.col("host"), F.col("path"), rules))
    return both.select("page_id", "url", "host", "path", F.col("m.rule").alias("rule"),
                       F.coalesce(F.col("m.verdict"), F.when(F.col("hit") == 1, "block")
                                  .otherwise("allow")).alias("verdict"),
                       (F.col("hit") == 1).eqNullSafe(True).alias("listed"))
