"""Chat formatting: a finite-state machine over roles, a template and a loss mask.

A template is data: the control strings, the machine's transitions and which
roles are trained on.  Each turn becomes three segments (opening, body, closing);
a segment carries its text and a loss flag.  Everything is a DataFrame expression.

Defined cases: a null or empty text is an empty body; a null role is the role
``""``; rows with equal conversation and turn are ordered by role, then text;
repeated rows are turns of their own; null conversation ids form one
conversation; a null turn number sorts first; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick


@dataclass(frozen=True)
class ChatTemplate:
    """A declarative chat format.

    ``transitions`` maps a state to {role: next state}; a role without an entry
    sends the machine to its dead state.  A conversation is valid if the machine
    ends in one of ``accepting``.
    """

    opening: str = "<|im_start|>"
    role_end: str = "\n"
    closing: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )

    DEAD = ""


def escape_text(text: Column) -> Column:
    r"""Make control strings harmless: every ``<``, n backslashes, ``|`` gets one more backslash.

    The result never holds ``<|``, and unescape_text() inverts it exactly.
    """
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Percent-encode what could end or imitate a role header."""
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("|", "%7C")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("|", "%7C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def _states(roles: Column, template: ChatTemplate) -> Column:
    """The machine's state after each prefix's last role, by folding the role array."""
    moves = F.create_map(
        *[F.lit(x) for state, by_role in template.transitions.items() for role, to in by_role.items() for x in (f"{state}\n{role}", to)]
    )
    dead = F.lit(template.DEAD)
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("read"), F.lit(-1).alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), role)), dead)
        bad = F.when((acc["bad"] < 0) & (to == dead), acc["read"]).otherwise(acc["bad"])
        return F.struct(to.alias("state"), (acc["read"] + 1).alias("read"), bad.alias("bad"))

    return F.aggregate(roles, begin, step)


def format_conversations(df: DataFrame, template: ChatTemplate = ChatTemplate(), invalid: str = "keep") -> DataFrame:
    """One row per conversation: conv_id, valid, first_bad_turn, segments, formatted.

    df has conv_id, turn, role and text.  ``segments`` is an array of
    (text, loss); their texts joined are ``formatted``.  ``first_bad_turn`` is
    the index of the first turn that the machine refuses (null if none; the
    number of turns if the conversation merely ends too early).  With
    ``invalid="drop"`` only valid conversations are returned.

    Turns are escaped and cut into segments before the only shuffle, by conv_id.
    A conversation is one record of the result, so its turns meet in one task.
    """
    rows = pick(df, "conv_id", "turn", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select(
        "conv_id",
        F.struct(F.col("turn"), role.alias("role"), escape_text(text).alias("body")).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    end = _states(F.col("turns.role"), template)

    def cut(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(template.opening), escape_role(t["role"]), F.lit(template.role_end)), F.lit(False)),
            piece(t["body"], t["role"].isin(*template.loss_roles)),
            piece(F.lit(template.closing), F.lit(False)),
        )

    out = grouped.select(
        "conv_id",
        end.alias("end"),
        F.flatten(F.transform("turns", cut)).alias("segments"),
    ).select(
        "conv_id",
        ((F.col("end.bad") < 0) & F.col("end.state").isin(*template.accepting)).alias("valid"),
        F.when(F.col("end.bad") >= 0, F.col("end.bad"))
        .when(~F.col("end.state").isin(*template.accepting), F.col("end.read"))
        .cast("long")
        .alias("first_bad_turn"),
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )
    return out.where("valid") if invalid == "drop" else out


def parse_formatted(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Read the turns back from a formatted conversation: an array of (role, text)."""
    closing = "".join("\\" + c if c in "<|>.*+?()[]{}^$\\" else c for c in template.closing)
    pieces = F.split(formatted, closing)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(template.opening) + 1))
        role = F.substring_index(rest, template.role_end, 1)
        body = F.substr(rest, F.length(role) + len(template.role_end) + 1)
        return F.struct(unescape_role(role).alias("role"), unescape_text(body).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    trained = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(trained, lambda s: unescape_text(s["text"])), "")


def digest_formatted(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """What format_conversations() wrote, read back and reduced to counts and digests."""
    read = formatted.select(
        "conv_id", "valid", "formatted", parse_formatted(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments")).alias("loss")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
