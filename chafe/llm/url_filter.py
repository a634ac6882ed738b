"""Operator 2 - URL filters: host and path rules, and a listed-URL check.

The list holds canonical URLs.  A blocked Bloom filter over it (blocks of
eight 32-bit words, one bit in each word) passes the possible hits; those alone
go on to an exact hash join with the list, which removes the false positives.
The filter is a table of blocks with a fixed largest size, so it is
broadcast whatever the list's size: a longer list raises the share of false
positives, never the broadcast and never the result.

A rule is a host suffix and a path prefix with a verdict.  The rule that fits
with the longest text decides; URLs that no rule fits are judged by the list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BITS_PER_URL = 16
MAX_BLOCKS = 1 << 16       # of 32 bytes: 2 MB of filter, the proven bound of the broadcast
WORDS = 8
# ---- fixed values: odd multipliers that spread a hash over the eight words ----
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D,
         0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
# -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    verdict: str      # allow or block
    host: str         # fits this host and all its subdomains
    path: str = "/"   # fits paths that start with it

    @property
    def text(self) -> str:
        return self.host + self.path


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased.
    Path: from there up to ? # or the end.  Null or no ://: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, 1 << 30))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., path without index page, page suffix
    and slash at the end; scheme, query and fragment don't count."""
    h = F.regexp_replace(host, r"^(www|m)\.", "")
    p = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", "")
    return F.when(host == "", F.lit(None).cast("string")).otherwise(F.concat(h, p))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _block_of(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks).cast("long")).cast("int")


def _bits_of(url: Column) -> list[Column]:
    """One bit in each word of the block, from a second hash: the product with
    the word's salt is kept to 32 bits, and its upper five choose the bit."""
    low = F.lit(0xFFFFFFFF).cast("long")
    h = F.hash(url).cast("long").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    at = [F.shiftrightunsigned((h * F.lit(s).cast("long")).bitwiseAND(low), 27).cast("int") for s in SALTS]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), a) for a in at]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7) of the listed URLs, at most ``n_blocks`` rows."""
    bits = _bits_of(F.col("url"))
    return listed.select(_block_of(F.col("url"), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)]) \
        .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url",
          page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of ``pages``.

    ``listed`` has a column url of canonical URLs to block (null and repeated
    ones don't matter).  Verdict: the fitting rule's, else block if the
    canonical URL is listed, else allow.  Defined cases: a null URL or one
    without :// has an empty host and path, fits no rule and is allowed;
    repeated rows each return a row; a null page_id stays; other columns are
    not read; an empty list allows what no rule blocks.
    """
    list_ = written(listed.select("url").where(F.col("url").isNotNull()).distinct())
    n = list_.count()
    n_blocks = min(MAX_BLOCKS, 1 << max(0, (n * BITS_PER_URL // (32 * WORDS)).bit_length()))
    host, path = host_and_path(F.col("__url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url")) \
        .select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("__by_rule"),
                       canonical(F.col("host"), F.col("path")).alias("__canon"))
    blocks = F.broadcast(bloom_blocks(list_, n_blocks))       # at most MAX_BLOCKS rows
    tested = rows.withColumn("block", _block_of(F.col("__canon"), n_blocks)).join(blocks, "block", "left")
    hit = F.lit(True)
    for i, b in enumerate(_bits_of(F.col("__canon"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) == b)
    tested = tested.withColumn("__maybe", F.coalesce(hit, F.lit(False)) & F.col("__by_rule").isNull()) \
        .select("page_id", "host", "path", "rule", "__by_rule", "__canon", "__maybe")
    sure = tested.where(~F.col("__maybe")).withColumn("listed", F.lit(False))
    maybe = tested.where("__maybe").join(list_.withColumnRenamed("url", "__listed"),
                                         F.col("__canon") == F.col("__listed"), "left") \
        .withColumn("listed", F.col("__listed").isNotNull())
    out = ["page_id", "host", "path", "rule", "__by_rule", "listed"]
    return sure.select(*out).unionByName(maybe.select(*out)).select(
        "page_id", "host", "path", "rule",
        F.coalesce("__by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
