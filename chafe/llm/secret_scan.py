"""Operator 9 - secret scan with corpus-wide ownership frequency (native).

Built-in functions only.  Three base kinds are found by regular expression; a
fourth, looser kind collects long mixed tokens.  Every candidate's value is
hashed, and the hashes are counted over distinct repositories and owners of the
whole corpus: a value that two or more owners hold, or three or more repositories
of one owner, is a copied example; any other looks live.  Base spans always
stay; the looser candidates become spans only if they look live.

Positions come from the text between matches: the lengths of the gaps
(``split``) and of the matches (``regexp_extract_all``) are summed up by a running
sum over the matches of a text.  Loose candidates that overlap base spans are
found by running extremes over the spans in order, so the work grows with the
number of matches, also where one text holds very many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# ---- fixed values: kinds in the order in which they are listed ----
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
# -------------------------------------------------------------------
# The access and hex matches are whole runs, so a run that is too short hides no
# longer one, and the length can stand in the expression.
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: A text that this finds nothing in has no candidate of any kind.
ANY = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}"
       r"|(?<![0-9a-f])[0-9a-f]{16}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}")
EXAMPLE_OWNERS = 2      # owners that make a value a copied example,
EXAMPLE_REPOS = 3       # or repositories, also of one owner


def _matches(text: Column, pattern: str, group: int, kind: int, keep: Callable[[Column], Column]) -> Column:
    """All leftmost non-overlapping matches in order, as (kind, nth, skip, size, value): the
    characters in front of it since the last match, its own, and the hash of its value
    (a group of the match); null for a value that is not kept."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    # the last gap has no match: its row in the zip is left out
    return F.transform(F.slice(rows, F.lit(1), F.size(whole)), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("skip"), F.length(x["whole"]).alias("size"),
        F.when(keep(x["value"]), F.sha2(x["value"], 256)).alias("value")))


def _spelled(spans: Column) -> Column:
    """kind:start:end of spans sorted by start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source",
               repo: str = "lang") -> DataFrame:
    """(rid, doc_id, owner, repo, matches), one row per input row."""
    t = F.coalesce(F.col("__t"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"),
                       F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"), F.col(text).alias("__t"))
    every = F.concat(_matches(t, ASSIGN, 2, 0, lambda v: F.length(v) >= MIN_ASSIGN),
                     _matches(t, ACCESS_LONG, 0, 1, lambda v: F.lit(True)),
                     _matches(t, HEX_LONG, 0, 2, lambda v: F.lit(True)),
                     _matches(t, TOKEN, 0, 3, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")))
    return rows.select("rid", "doc_id", "owner", "repo", F.when(t.rlike(ANY), every).alias("matches"))


def placed(rows: DataFrame) -> DataFrame:
    """(rid, owner, repo, kind, start, end, value) of base candidates, and of the loose ones
    that overlap none of them."""
    hits = rows.select("rid", "owner", "repo", F.explode("matches").alias("m")).select("rid", "owner", "repo", "m.*")
    so_far = Window.partitionBy("rid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    spans = hits.withColumn("end", F.sum(F.col("skip") + F.col("size")).over(so_far).cast("int")) \
        .withColumn("start", F.col("end") - F.col("size")).where(F.col("value").isNotNull())
    base = F.col("kind") < 3
    behind = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    reach, next_ = F.max(F.when(base, F.col("end"))).over(behind), F.min(F.when(base, F.col("start"))).over(ahead)
    apart = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return spans.withColumn("reach", reach).withColumn("next", next_).where(base | apart) \
        .select("rid", "owner", "repo", "kind", "start", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repos): distinct owners and repositories (of an owner) that
    hold a candidate value.  Counted in steps of one group each, so that
    a value that a third of the corpus copies is combined before each shuffle."""
    return found.groupBy("value", "owner", "repo").agg(F.count("*").alias("n")) \
        .groupBy("value", "owner").agg(F.count("*").alias("repos")) \
        .groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source",
         repo: str = "lang") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example), one
    row per input row.

    n_live and n_example split the base spans by owners and repositories of their
    value.  Defined cases: null and empty texts have no spans (the hash is that of
    an empty string); a null owner or repository counts as one of its own; repeated
    rows each return a row (and count as one holder); a null doc_id stays; texts of
    any length are searched whole, in time linear in their matches; a table
    without rows returns none; other columns are not read.
    """
    rows = written(candidates(docs, text, doc_id, owner, repo))
    found = written(placed(rows))
    counted = written(ownership(found))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS)
    base = F.col("kind") < 3
    of = lambda k: F.count_if(F.col("kind") == k).alias(KINDS[k])
    # both inputs are scans, so a hot value's rows can be split
    spans = found.select("rid", "start", "kind", "end", "value").join(counted, "value") \
        .where(base | ~example).groupBy("rid") \
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"), of(0), of(1), of(2),
             F.count_if(base & ~example).alias("live"), F.count_if(base & example).alias("example"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    listed = F.coalesce(F.col("all"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return rows.select("rid", "doc_id").join(spans, "rid", "left").select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(_spelled(F.filter(listed, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _spelled(listed).alias("spans"), number("live").alias("n_live"), number("example").alias("n_example"))
