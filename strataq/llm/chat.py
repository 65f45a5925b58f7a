"""Chat formatting from a declarative template, with loss flags; built-in functions only.

A finite-state machine over the roles validates the order of turns. Each turn becomes the segments that the
template lists, each with a flag that says if the loss counts it. Inside texts a control string can't occur: of
``<`` and the bars after it one bar more is written, and one is taken away on reading, so nothing is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``turn``: the pieces of a turn, a literal, ``{role}`` or ``{text}``, and whose turns the loss counts there.

    ``steps``: for each state of the machine the roles that may follow; a role is the name of the next state.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    turn: tuple[tuple[str, tuple[str, ...]], ...] = (("{open}", ()), ("{role}", ()), ("{after_role}", ()), ("{text}", ("assistant",)), ("{close}", ()))
    start: str = "start"
    steps: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("start", ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user", "tool")),
        ("tool", ("assistant",)),
    )
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(?=\|)", "<|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(?=\|)", "<")


def escape_role(role: Column) -> Column:
    """Roles end at a line break, so theirs are written as \\n, a backslash as two."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, valid, bad_turn, segments (text, loss), formatted.

    ``rows``: conv_id, turn, role, text. Turns come in order, null first; equal turns by role, then text.
    A null text or role is empty; rows without conv_id are one conversation. valid: the machine takes every
    role and ends in a final state; bad_turn: place of the first role it doesn't take (null: none). All
    conversations are formatted, valid or not. No rows give an empty result; other columns are ignored.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    allowed = F.create_map(*[F.lit(x) for state, roles in template.steps for x in (state, ",".join(roles))])

    def step(acc: Column, t: Column) -> Column:
        takes = F.array_contains(F.split(F.coalesce(F.try_element_at(allowed, acc["state"]), F.lit("")), ","), t["role"]) & (t["role"] != "")
        bad = F.when(acc["bad"].isNotNull() | takes, acc["bad"]).otherwise(acc["n"])
        return F.struct(t["role"].alias("state"), (acc["n"] + 1).alias("n"), bad.cast("int").alias("bad"))

    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    machine = F.aggregate("turns", first, step)

    def segments(t: Column) -> Column:
        made = []
        for what, literal, counted in pieces_of(template):
            text = F.lit(what) if literal else escape_role(t["role"]) if what == "role" else escape(t["text"])
            made.append(F.struct(text.alias("text"), (t["role"].isin(*counted) if counted else F.lit(False)).alias("loss")))
        return F.array(*made)

    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), machine.alias("m"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select(
        "conv_id", "n_turns",
        (F.col("m.bad").isNull() & F.col("m.state").isin(*template.final)).alias("valid"), F.col("m.bad").alias("bad_turn"),
        "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def pieces_of(template: Template) -> list[tuple[str, bool, tuple[str, ...]]]:
    """The pieces of a turn: what is written (a literal, or role or text), whether it is a literal, whose loss counts it.

    A turn can be read back if it begins and ends with a literal that texts can't hold (it has ``<|``, which is
    escaped there), what follows the text is such a literal, and what follows the role is that or has a line break.
    """
    literals = {"{open}": template.open, "{after_role}": template.after_role, "{close}": template.close}
    made = [(piece[1:-1], False, counted) if piece in ("{role}", "{text}") else (literals.get(piece, piece), True, counted) for piece, counted in template.turn]
    for k, (what, literal, _) in enumerate(made):
        after = made[k + 1][0] if k + 1 < len(made) and made[k + 1][1] else ""
        if not literal and not ("<|" in after or (what == "role" and after.startswith("\n"))):
            raise ValueError(f"nothing shows where the {what} ends")
    if not (made[0][1] and made[-1][1] and "<|" in made[-1][0]):
        raise ValueError("a turn must begin and end with literals")
    return made


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) that a formatted conversation holds, read by the template's pieces in order."""
    made = pieces_of(template)
    closing = made[-1][0]
    parts = F.split(formatted, "\\Q" + closing + "\\E")
    whole = F.slice(parts, 1, F.size(parts) - 1)  # what follows the last turn's end is empty

    def turn(rest: Column) -> Column:
        fields = {"role": F.lit(""), "text": F.lit("")}
        for k, (what, literal, _) in enumerate(made):
            if literal:
                rest = F.substring(rest, F.lit(len(what) + 1), F.length(rest))
            elif made[k + 1][0] == closing and k + 2 == len(made):
                fields[what] = rest
            else:
                fields[what] = F.substring_index(rest, made[k + 1][0], 1)
                rest = F.substring(rest, F.length(fields[what]) + 1, F.length(rest))
        return F.struct(unescape_role(fields["role"]).alias("role"), unescape(fields["text"]).alias("text"))

    return F.transform(whole, turn)


def digests(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """What the formatted output says when it is read back: turns, text under the loss, their digests."""
    read = chats.withColumn("read", read_turns(F.col("formatted"), template))

    def counted(t: Column) -> Column:
        under = [F.when(t["role"].isin(*roles), F.lit(what) if literal else t[what]).otherwise("") for what, literal, roles in pieces_of(template) if roles]
        return F.concat(*under) if under else F.lit("")

    loss = F.array_join(F.transform("read", counted), "")
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
