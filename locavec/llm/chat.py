"""Chat formatting: a finite-state machine over roles checks the turn order, and a declarative template turns every
conversation into text segments with a loss flag each. Turns are sorted by Spark, which spills, and streamed one by one: no
conversation is held as a whole, however many turns it has.

The template marks a turn as start + role + newline + text + end. Control strings inside texts are escaped reversibly: each run
``<``, backslashes, ``|`` gets one more backslash. Roles are percent-coded where they hold ``%``, a newline or ``<``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed control strings.
START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Template:
    """Control strings, the roles under the loss mask, and the machine: state -> {role: next state}."""

    start: str = START
    end: str = END
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict = field(default_factory=lambda: {
        "begin": {"system": "open", "user": "asked"},
        "open": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    initial: str = "begin"
    final: tuple[str, ...] = ("answered",)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unescape_role(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


class Conversation:
    """State of the machine, counters and hashes of the turns so far."""

    def __init__(self, key, t: Template):
        self.key, self.t, self.state = key, t, t.initial
        self.turns = self.segments = self.formatted = self.loss_chars = 0
        self.all, self.said = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of the next turn; counts and hashes are read back from them."""
        t = self.t
        self.state = t.moves.get(self.state, {}).get(role)
        out = [(f"{t.start}{escape_role(role)}\n", False), (escape(text), role in t.loss_roles), (t.end, False)]
        body = unescape(out[1][0])
        self.turns += 1
        self.segments += len(out)
        self.formatted += sum(len(s) for s, _ in out)
        self.all.update(f"{unescape_role(out[0][0][len(t.start):-1])}\n{body}\n".encode())
        if out[1][1]:
            self.loss_chars += len(body)
            self.said.update(body.encode())
        return out

    def close(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.said.hexdigest(), self.formatted, self.state in self.t.final


#: Columns of the closing row of a conversation.
CLOSING = ("n_turns long", "turns_sha256 string", "loss_chars long", "loss_sha256 string", "formatted_chars long", "valid boolean")
_ROWS, _CHARS = 1 << 13, 1 << 22  # bounds of an output batch


def format_chats(rows: DataFrame, template: Template | None = None, *, key: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per segment (key, position, segment, loss), and one closing row per conversation with the columns ``CLOSING`` and
    a null position. The segments of a conversation, joined by position, are its formatted text.

    Turns stand in the order of ``turn`` (null first), equal ones by role and text; repeated rows are turns of their own. Null
    texts and roles are empty. Conversations that the machine refuses are formatted too, with valid = false. Rows with a null key are
    one conversation. Other columns are not read. A conversation is streamed by one task, because its hashes run over its turns in order.
    """
    t = template or Template()
    turns = rows.select(F.col(key).alias("k"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = turns.schema["k"].dataType.simpleString()
    names = [key, "position", "segment", "loss", *[c.split()[0] for c in CLOSING]]
    none = (None,) * len(CLOSING)

    def run(batches):
        chat, out, chars = None, [], 0

        def batch(at):
            kinds = [at, pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            return done

        for b in batches:
            at = b.schema.field(0).type
            for i in range(b.num_rows):
                k, said = b.column(0)[i].as_py(), b.column(3)[i].as_py()
                if chat is None or k != chat.key:
                    if chat is not None:
                        out.append((chat.key, None, None, None, *chat.close()))
                    chat = Conversation(k, t)
                n = chat.segments
                out += [(k, n + j, s, loss, *none) for j, (s, loss) in enumerate(chat.add(b.column(2)[i].as_py(), said))]
                chars += len(said)
                if len(out) >= _ROWS or chars >= _CHARS:
                    yield batch(at)
                    chars = 0
        if chat is not None:
            out.append((chat.key, None, None, None, *chat.close()))
            yield batch(at)

    ddl = f"`{key}` {kind}, position long, segment string, loss boolean, " + ", ".join(CLOSING)
    return turns.repartition("k").sortWithinPartitions("k", "turn", "role", "text").mapInArrow(run, ddl)


def digest(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """The closing rows: counts and hashes that were read back from the segments."""
    return chats.where("position IS NULL").select(key, *[c.split()[0] for c in CLOSING])
