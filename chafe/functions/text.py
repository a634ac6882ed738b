"""Column expressions for keys, timestamps, bot flags and text cleaning
(P1-P27).  All built-in Spark functions: they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Author patterns that mark automated accounts (matched as regular
# expressions on the lowercased user name).
BOT_PATTERNS = [r"\[bot\]", "jenkins", "ci/cd", "linter", "coverage",
                "dependabot", "coderabbit", "copilot"]
# Replacement tokens used by the cleaner.
CODE_BLOCK_TOKEN = "[CODE_BLOCK]"
INLINE_CODE_TOKEN = "[CODE]"
# Minimum cleaned length: texts must be longer than this many characters.
MIN_TEXT_LENGTH = 10
# Friction bands: low below 0.2, medium below 0.5, high otherwise.
FRICTION_BANDS = (0.2, 0.5)
# Outcome bands used for the outcome comparison: 0.2 and 0.4.
OUTCOME_BANDS = (0.2, 0.4)
TRIAGE_THRESHOLD = 0.4
# ---------------------------------------------------------------------------

# Every code point Python's ``\s`` matches.  Java's ``\s`` is ASCII-only, so
# the class is spelled out; the same pattern also runs unchanged in RE2.
WHITESPACE_RUN = (r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
# Same code points for Java's engine: Unicode White_Space plus U+001C-001F.
# Checked equal to the class above for every code point; about 4x faster.
WHITESPACE_RUN_JAVA = r"(?U)[\s\x1c-\x1f]+"
FENCE = r"```[\s\S]*?```"
INLINE = r"`[^`]+`"
BOT_REGEX = "|".join(BOT_PATTERNS)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c) -> Column:
    """Timestamp, or null when unparseable (strings) / cast (NTZ)."""
    c = col_(c)
    return F.try_to_timestamp(c.cast("string"))


def as_ts(c) -> Column:
    """Timestamps (incl. timestamp_ntz) and ISO strings to session-zone timestamps;
    a string that is no timestamp becomes null instead of ending the job."""
    return col_(c).try_cast("timestamp")


def duration_s(start, end) -> Column:
    """Fractional seconds between two timestamps (null if either is)."""
    return (F.unix_micros(as_ts(end)) - F.unix_micros(as_ts(start))) / F.lit(1_000_000.0)


def duration_h(start, end) -> Column:
    return (F.unix_micros(as_ts(end)) - F.unix_micros(as_ts(start))) / F.lit(3_600_000_000.0)


def keep_duration(d, min_seconds: float = 60.0) -> Column:
    """P3 predicate: drop quick closes, keep open (null duration) rows."""
    d = col_(d)
    return d.isNull() | (d >= F.lit(min_seconds))


def with_default(c, value) -> Column:
    """P4."""
    return F.coalesce(col_(c), F.lit(value))


def _has_parts(c, n: int) -> Column:
    """At least ``n`` parts between slashes, one of them 'repos'.

    Byte searches: the join keys end up in pushed filters several times, where
    every splitting of the URL would be done anew."""
    u = col_(c)
    return (F.substring_index(u, "/", n - 1) != u) & F.concat(F.lit("/"), u, F.lit("/")).contains("/repos/")


def pr_key_from_url(c) -> tuple[Column, Column]:
    """API pull-request URL -> (owner/repo, PR number).

    Parts lie between '/'; need at least 7 parts and a 'repos' part; owner/repo are
    the 4th and 3rd parts from the end, the number is the last part.
    Anything else gives null keys, which never join.
    """
    ok, u = _has_parts(c, 7), col_(c)
    repo = F.when(ok, F.substring_index(F.substring_index(u, "/", -4), "/", 2))
    num = F.when(ok, to_number(F.substring_index(u, "/", -1)))
    return repo, num


def to_number(c) -> Column:
    """String to integer, malformed -> null (surrounding blanks allowed)."""
    return F.trim(col_(c)).try_cast("bigint")


def repo_from_url(c) -> Column:
    """Repository URL -> owner/repo (last two parts; >= 5 parts, 'repos')."""
    return F.when(_has_parts(c, 5), F.substring_index(col_(c), "/", -2))


def is_bot(user, user_type=None) -> Column:
    """Author matches a bot pattern, or the account type is Bot.
    A null user is not a bot."""
    flag = F.coalesce(F.lower(col_(user)).rlike(BOT_REGEX), F.lit(False))
    if user_type is not None:
        flag = flag | F.coalesce(col_(user_type) == F.lit("Bot"), F.lit(False))
    return flag


def clean_text(c) -> Column:
    """Fenced blocks -> [CODE_BLOCK], inline code -> [CODE], whitespace
    runs -> one space, trimmed; null -> ''."""
    c = col_(c)
    code = F.regexp_replace(F.regexp_replace(c, FENCE, CODE_BLOCK_TOKEN), INLINE, INLINE_CODE_TOKEN)
    # both code patterns need a backtick: a byte search skips two regex
    # passes for the (common) texts without one
    t = F.when(c.contains("`"), code).otherwise(c)
    t = F.regexp_replace(t, WHITESPACE_RUN_JAVA, " ")
    return F.coalesce(F.trim(t), F.lit(""))


def long_enough(c, n: int = MIN_TEXT_LENGTH) -> Column:
    """Keep texts longer than ``n`` characters (code points)."""
    return F.length(col_(c)) > F.lit(n)


def merged_flag(state) -> Column:
    """1 when the lowercased state contains 'merge' (null -> 0)."""
    return F.coalesce(F.lower(col_(state)).contains("merge"), F.lit(False)).cast("int")


def merged_at_flag(merged_at) -> Column:
    """P16 variant: merged means a merge timestamp exists."""
    return col_(merged_at).isNotNull().cast("int")


def month_of(ts) -> Column:
    """P17: 'yyyy-MM' period label."""
    return F.date_format(as_ts(ts), "yyyy-MM")


def valid_hours(h, upper: float = 8760.0) -> Column:
    """0 < hours < one year."""
    h = col_(h)
    return h.isNotNull() & (h > 0) & (h < F.lit(upper))


def friction_band(score, cuts: Sequence[float] = FRICTION_BANDS,
                  names: Sequence[str] = ("low", "medium", "high")) -> Column:
    """Label by cut points (left-closed bands)."""
    s = col_(score)
    e = F.when(s < F.lit(cuts[0]), F.lit(names[0]))
    for cut, name in zip(cuts[1:], names[1:-1]):
        e = e.when(s < F.lit(cut), F.lit(name))
    return F.when(s.isNull(), F.lit(None)).otherwise(e.otherwise(F.lit(names[-1])))


def triage(score, threshold: float = TRIAGE_THRESHOLD) -> Column:
    """P27."""
    return col_(score) > F.lit(threshold)
