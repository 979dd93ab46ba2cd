"""Chat formatting with columns only: a finite-state machine over roles, and segments with loss flags from a template.

A conversation's rows are ordered by turn (ties by role, then text), validated by folding the machine's transitions over
the roles, and emitted as segments: what the template puts around a text is one segment, the escaped text another, each
with its loss flag. `formatted` is the segments joined. A conversation is one output string, so its rows meet in one
row by definition; nothing else is gathered.

Defined results: null text and role are empty; conversations of unknown roles or bad order are formatted too, with
valid = false and the first bad turn's position; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "begin": "<s>",
    "open": ("<|role:", "|>\n"),
    "close": "<|end|>\n",
    "end": "</s>",
    "loss": ["assistant"],
    "start": "start",
    "accept": ["answered"],
    "moves": {
        ("start", "system"): "primed",
        ("start", "user"): "asked",
        ("primed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
        ("answered", "tool"): "asked",
    },
}
#: In this order; every control string of a template has to hold one of the last three characters.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;")]


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def bind(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def machine(roles: Column, template: dict = TEMPLATE) -> Column:
    """struct(state, position of the first bad turn or null) after all roles."""
    moves = F.create_map(*[F.lit(x) for (s, r), t in template["moves"].items() for x in (f"{s}>{r}", t)])
    start = F.struct(F.lit(template["start"]).alias("state"), F.lit(None).cast("long").alias("bad"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, role: Column) -> Column:
        to = F.get(F.transform(F.array(F.concat(acc["state"], F.lit(">"), role)), lambda k: F.element_at(moves, k)), F.lit(0))
        bad = F.coalesce(acc["bad"], F.when(to.isNull(), acc["n"]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), bad.alias("bad"), (acc["n"] + 1).alias("n"))

    return F.aggregate(roles, start, step)


def format_chats(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn."""
    turns = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.concat(
        F.array(segment(F.lit(template["begin"]), no)),
        F.flatten(
            F.transform(
                "turns",
                lambda t: F.array(
                    segment(F.concat(F.lit(template["open"][0]), escape(t["role"]), F.lit(template["open"][1])), no),
                    segment(escape(t["text"]), t["role"].isin(template["loss"])),
                    segment(F.lit(template["close"]), no),
                ),
            )
        ),
        F.array(segment(F.lit(template["end"]), no)),
    )
    state = machine(F.transform("turns", lambda t: t["role"]), template)
    return (
        turns.select("conv_id", segments.alias("segments"), state.alias("_state"))
        .select(
            "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            (F.col("_state")["bad"].isNull() & F.col("_state")["state"].isin(template["accept"])).alias("valid"), F.col("_state")["bad"].alias("bad_turn"),
        )
    )


def read_chats(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    opened, named = template["open"]
    chunks = F.split(formatted, r"\Q" + opened + r"\E", -1)
    return F.transform(
        F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0))),
        lambda c: F.struct(
            unescape(F.substring_index(c, named, 1)).alias("role"),
            unescape(F.substring_index(F.substr(c, F.instr(c, F.lit(named)) + len(named)), template["close"], 1)).alias("text"),
        ),
    )
