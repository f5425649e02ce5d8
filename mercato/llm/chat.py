"""Chat formatting: a declarative template, a finite-state machine over roles, and text segments with loss flags.

Everything is an expression over the array of one conversation's turns. A conversation is one record of the output, so
its turns meet in one row; nothing else is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles are trained on, and which role may follow which state.

    ``open`` + role + ``between`` + text + ``close``. ``follows`` maps a state (the last role; ``start`` before the first
    turn) to the roles that may come next; ``ends`` are states in which a conversation may end. ``marks`` begins every control
    string and is what gets escaped in texts and roles.
    """

    open: str = "<|im_start|>"
    between: str = "\n"
    close: str = "<|im_end|>\n"
    marks: str = "<|"
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    ends: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column, t: Template = CHATML) -> Column:
    r"""Reversible: a backslash becomes ``\b``, then the mark's first character is split from its rest by ``\p``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit(t.marks), F.lit(t.marks[0] + "\\p" + t.marks[1:]))


def unescape(text: Column, t: Template = CHATML) -> Column:
    return F.replace(F.replace(text, F.lit(t.marks[0] + "\\p" + t.marks[1:]), F.lit(t.marks)), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column, t: Template) -> Column:
    return F.replace(escape(role, t), F.lit(t.between), F.lit("\\n"))


def _unescape_role(role: Column, t: Template) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit(t.between)), t)


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = CHATML
) -> DataFrame:
    """A row per conversation: conv_id, segments array<struct<text, loss>>, formatted, n_bad_turns, valid.

    ``formatted`` is the segments' texts joined. A turn gives three segments: its head, its escaped text (under the loss if the
    role is trained on), its tail. Turns are ordered by turn (null first), then role, then text; repeated rows are turns of
    their own. Null role and text count as empty. The machine is reset to a turn's role also where that role may not follow;
    such turns are counted, and ``valid`` says that there are none and the end is allowed. Invalid conversations are formatted
    all the same. A null conversation id is a conversation. An empty table gives no rows; other columns are not read.
    A conversation is one record: texts of any length are held whole, several times over, in one task.
    """
    t = template
    one = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    each = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    allowed = F.array(*[F.lit(f"{a}\0{b}") for a, after in t.follows.items() for b in after])
    step = F.transform("turns", lambda x, i: F.concat(F.when(i == 0, F.lit("start")).otherwise(F.get(F.col("turns"), i - 1)["r"]), F.lit("\0"), x["r"]))
    part = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                part(F.concat(F.lit(t.open), _escape_role(x["r"], t), F.lit(t.between)), F.lit(False)),
                part(escape(x["x"], t), x["r"].isin(*t.trained)),
                part(F.lit(t.close), F.lit(False)),
            ),
        )
    )
    out = each.select(
        "conv_id", pieces.alias("segments"), F.size(F.filter(step, lambda s: ~F.array_contains(allowed, s))).cast("long").alias("n_bad_turns"),
        F.element_at("turns", -1)["r"].isin(*t.ends).alias("ended"),
    )
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", "segments", joined.alias("formatted"), "n_bad_turns", ((F.col("n_bad_turns") == 0) & F.col("ended")).alias("valid"))


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """The turns (array<struct<role, text>>) and loss_text of formatted conversations, from ``formatted`` and ``segments``."""
    t = template
    blocks = F.filter(F.split("formatted", "\\Q" + t.close + "\\E"), lambda b: b != "")
    heads = F.transform(blocks, lambda b: F.substr(b, F.lit(len(t.open) + 1)))
    turns = F.transform(
        heads,
        lambda b: F.struct(
            _unescape_role(F.substring_index(b, t.between, 1), t).alias("role"),
            unescape(F.substr(b, F.length(F.substring_index(b, t.between, 1)) + F.lit(1 + len(t.between))), t).alias("text"),
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_text"))
