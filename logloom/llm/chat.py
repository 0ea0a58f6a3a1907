"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns are sorted, walked by the machine, which says whether their order is valid,
and written out as segments: marks without loss, contents with the loss flag of their role. Control
strings inside texts are escaped, and the reader below takes everything back from the output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles under the loss mask, and the machine: (state, role) -> state.

    ``controls``: strings that must not come from a text; the marks and the strings of usual other
    templates. Each is escaped by a backslash after its first character, a backslash by another.
    """

    begin: str = "<|start|>"
    middle: str = "<|message|>"
    end: str = "<|end|>"
    loss: tuple[str, ...] = ("assistant",)
    first: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )
    last: tuple[str, ...] = ("assistant",)
    #: How control strings start.
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]")

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
        return out

    def unescape(self, text: Column) -> Column:
        """Every backslash of an escaped text announces the character after it."""
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def valid(self, roles: Column) -> Column:
        """Whether the machine takes all roles and ends in a last state; an unknown role or turn stops it for good."""
        moves = F.create_map(*[F.lit(x) for (state, role), to in self.moves.items() for x in (f"{state}\n{role}", to)])
        end = F.aggregate(roles, F.lit(self.first), lambda state, role: F.coalesce(F.try_element_at(moves, F.concat_ws("\n", state, role)), F.lit("stopped")))
        return end.isin(*self.last)


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """``conv_id, n_turns, valid, segments`` for each conversation of ``conv_id, turn, role, text`` rows.

    ``segments``: array of (text, loss), three or so for each turn; joined, they are the formatted
    text. Turns stand by turn, ties by role and text, null turns first; a null role or text is
    empty, and repeated rows are turns of their own. A null conv_id is a conversation too. Other
    columns are ignored. Invalid conversations are formatted like all others and marked. A
    conversation is one row of the result, so its rows meet in one task: that is the output's
    size, as no two conversations do.
    """
    told = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = told.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        no = F.lit(False)
        return F.array(
            F.struct(F.concat(F.lit(template.begin), template.escape(t.role), F.lit(template.middle)).alias("text"), no.alias("loss")),
            F.struct(template.escape(t.text).alias("text"), t.role.isin(*template.loss).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), no.alias("loss")),
        )

    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), template.valid(F.col("turns.role")).alias("valid"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:  # noqa: B008
    """The turns (role, text) of a formatted text."""
    quoted = lambda s: "\\Q" + s + "\\E"
    turns = F.filter(F.split(formatted, quoted(template.end)), lambda x: x != "")
    parts = lambda x: F.split(F.substring(x, len(template.begin) + 1, F.length(x)), quoted(template.middle))
    return F.transform(turns, lambda x: F.struct(template.unescape(F.get(parts(x), F.lit(0))).alias("role"), template.unescape(F.get(parts(x), F.lit(1))).alias("text")))


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """What can be told from the output alone: turns, and text under the loss mask."""
    text = F.array_join(F.transform("segments", lambda s: s.text), "")
    under = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: template.unescape(s.text)), "")
    known = formatted.withColumns({"formatted": text, "under": under})
    turns = read_back(F.col("formatted"), template)
    told = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return known.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2(F.col("under"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
