"""Operator 13 - chat formatting with a grammar round trip.

The template, in the style of instruction-tuned chat models (``_`` is one blank):

    conversation := <s> turn*
    turn         := [INST]_ body _[/INST]          role user
                  | <<SYS>>_ body _<</SYS>>        role system
                  | _ body </s>                    role assistant
                  | [ROLE=name]_ body _[/ROLE]     any other role

Each turn starts with another symbol, and a body holds no control string, so the
parser is deterministic: it looks at the opener and reads up to the next control
string, which must be the turn's closer.  Anything else is a syntax error.

A body is written as it is and parsed back; if the recovered turn differs from
its source (it holds a control string, or something that looks like an escaped
one), the conflicting places are escaped and the turn is parsed again, until both
are identical.  An escape puts one backslash behind the first character of a
control string (``<\\/s>``), also where backslashes stand there already; the
parser takes one away.  So ordinary texts are never changed.

A conversation is written as parts of a bounded number of characters, each a
row with its loss spans; nearly all conversations are one part.  Both passes
stream over sorted rows and hold one part, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, scratch

BEGIN = "<s>"
# ---- fixed values: opener and closer of each role; the control strings ----
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": (" ", "</s>")}
ROLE_OPEN, ROLE_MID, ROLE_CLOSE = "[ROLE=", "] ", " [/ROLE]"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE=", "[/ROLE]")
# ---------------------------------------------------------------------------
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
# a control string with any number of backslashes behind its first character
_LIKE = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROLS))
PART_CHARS = 1 << 20      # a part of a conversation ends with the turn that passes this length
PARTS = "conv_id long, part int, last boolean, n_turns long, text string, loss array<struct<start:int,end:int>>"


class GrammarError(ValueError):
    """The text does not follow the template."""


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    start: int = 0    # of the body as it is written
    end: int = 0


def escape(body: str) -> str:
    return _LIKE.sub(lambda m: m[0][0] + "\\" + m[0][1:], body)


def unescape(body: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], body) if "\\" in body else body


def _role_name(role: str) -> str:
    return role.replace("%", "%25").replace("[", "%5B").replace("]", "%5D").replace("<", "%3C")


def _role_of(name: str) -> str:
    return name.replace("%3C", "<").replace("%5D", "]").replace("%5B", "[").replace("%25", "%")


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"{ROLE_OPEN}{_role_name(role)}{ROLE_MID}", ROLE_CLOSE)


def parse_turn(text: str, at: int) -> tuple[Turn, int]:
    """The turn that starts at ``at``, and where it ends."""
    for role, (opener, closer) in MARKS.items():
        if text.startswith(opener, at):
            start = at + len(opener)
            break
    else:
        if not text.startswith(ROLE_OPEN, at):
            raise GrammarError(f"no turn starts at {at}")
        stop = text.find(ROLE_MID, at)
        if stop < 0:
            raise GrammarError(f"the role at {at} does not end")
        role, closer, start = _role_of(text[at + len(ROLE_OPEN):stop]), ROLE_CLOSE, stop + len(ROLE_MID)
    m = CONTROL.search(text, start)
    if m is None:
        raise GrammarError(f"the turn at {at} is not closed")
    end = m.end() - len(closer)
    if end < start or text[end:m.end()] != closer:
        raise GrammarError(f"control string {m[0]} inside the turn at {at}")
    return Turn(role, unescape(text[start:end]), start, end), m.end()


def parse(text: str) -> list[Turn]:
    """All turns of a formatted text (the first part of a conversation, or a later one)."""
    at = len(BEGIN) if text.startswith(BEGIN) else 0
    turns = []
    while at < len(text):
        turn, at = parse_turn(text, at)
        turns.append(turn)
    return turns


def recovered(piece: str) -> tuple[str, str] | None:
    """(role, text) of a piece that is exactly one turn, else None."""
    try:
        turn, at = parse_turn(piece, 0)
    except GrammarError:
        return None
    return (turn.role, turn.text) if at == len(piece) else None


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(written turn, start and end of its body); what the parser recovers equals the source."""
    opener, closer = marks(role)
    body = text
    while recovered(opener + body + closer) != (role, text):
        if len(body) > 2 * len(text) + 64:
            raise GrammarError(f"no escape makes this turn of role {role!r} identical")
        body = escape(body)
    return opener + body + closer, len(opener), len(opener) + len(body)


def _write_parts(batches: Iterator[pa.RecordBatch], part_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (conv_id, turn) -> parts."""
    out: list[tuple] = []
    size = 0
    conv, open_, part, text, loss, chars, turns = None, False, 0, [BEGIN], [], len(BEGIN), 0

    def close(last: bool) -> None:
        nonlocal part, text, loss, chars, turns, size
        out.append((conv, part, last, turns, "".join(text), loss))
        size += chars
        part, text, loss, chars, turns = part + 1, [], [], 0, 0

    def batch() -> pa.RecordBatch:
        nonlocal out, size
        loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), loss_type)
        names = ("conv_id", "part", "last", "n_turns", "text", "loss")
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        out, size = [], 0
        return b
    for b in batches:
        for c, role, body in zip(*(b.column(i).to_pylist() for i in range(3))):
            if not open_ or c != conv:
                if open_:
                    close(True)
                conv, open_, part, text, loss, chars, turns = c, True, 0, [BEGIN], [], len(BEGIN), 0
            elif chars > part_chars:
                close(False)
            if size > part_chars:
                yield batch()
            piece, start, end = render_turn(role, body)
            if role == "assistant":
                loss.append({"start": chars + start, "end": chars + end})
            text.append(piece)
            chars, turns = chars + len(piece), turns + 1
    if open_:
        close(True)
    if out:
        yield batch()


def format_conversations(conversations: DataFrame, folder: str | None = None,
                         part_chars: int = PART_CHARS) -> str:
    """Write the formatted conversations as Parquet and return the folder.

    Columns: conv_id, part (from 0), last, n_turns, text, and loss: spans
    [start, end) in code points of the part's text that a model is trained on,
    one for each assistant body.

    Defined cases: rows go by turn, null first; rows of one turn by role, then
    text; repeated rows are turns of their own.  A null text or role is empty.
    Rows without a conv_id are one conversation without an id.  Texts are
    written whole; a conversation beyond ``part_chars`` characters is written
    in several parts, cut between turns.  An empty table has no parts.  Other
    columns are not read.
    """
    spark = conversations.sparkSession
    byte_batches(spark)
    folder = folder or f"{scratch(spark)}/chat-{uuid.uuid4().hex}"
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
                                F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text")) \
        .repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    rows.select("conv_id", "role", "text") \
        .mapInArrow(lambda batches: _write_parts(batches, part_chars), PARTS).write.parquet(folder)
    return folder


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order -> one row for each conversation, from what the parser recovers."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    n = lost = chars = 0
    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
    for b in batches:
        out = []
        for conv, last, text, loss in zip(*(b.column(i).to_pylist() for i in range(4))):
            for t in parse(text):
                turns_sha.update(f"{t.role}\n{t.text}\n".encode())
                n += 1
            for span in loss:
                body = unescape(text[span["start"]:span["end"]])
                loss_sha.update(body.encode())
                lost += len(body)
            chars += len(text)
            if last:
                out.append((conv, n, turns_sha.hexdigest(), lost, loss_sha.hexdigest(), chars))
                n = lost = chars = 0
                turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def read_digests(parts: DataFrame) -> DataFrame:
    """What the written parts hold, one row for each conversation.

    A conversation of one part is read where it is; the parts of longer ones
    are brought together in order and streamed through the digests."""
    byte_batches(parts.sparkSession)
    columns = ["conv_id", "last", "text", "loss"]
    whole = (F.col("part") == 0) & F.col("last")
    one = parts.where(whole).select(*columns)
    many = parts.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part").select(*columns)
    return one.mapInArrow(_digests, DIGEST).unionByName(many.mapInArrow(_digests, DIGEST))
