"""Chat formatting with DataFrame operations only: a finite-state machine over roles and a declarative template.

TEMPLATE names for each role whether its text is trained on, and the strings around a turn; NEXT lists for each state (the
last role, or start) the roles that may follow. A conversation's turns run through the machine, which yields whether their
order is valid and the first turn that is not; its text is emitted as segments with a loss flag each, and formatted is the
segments joined. Texts and roles are escaped so that they hold no control string, and reading restores them exactly: the first
characters of the template's strings, and the backslash that marks an escape, do not occur in an escaped text. A template whose
strings could be taken for each other, or begin with a letter or digit, is refused.

Nulls: a null text or role counts as empty, a null conv_id is a conversation of its own. Turns are ordered by turn (null
first), ties by role and text; repeated rows are turns of their own. Conversations that break the order are formatted as
well and say so in valid and bad_turn. A conversation becomes one row, whatever its length, so it must fit a cell (2 GB); the
rows without a conv_id, too, form one. An empty table gives an empty table; further columns, also of clashing names, are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {"head": "### ", "mid": ": ", "tail": "</turn>\n", "loss": ("assistant",)}
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Letters after a backslash that stand for escaped characters; other characters have their code there.
LETTERS = {"\\": "b", "<": "l", "#": "h", ":": "c", "\n": "n"}


def _rules(*characters: str) -> tuple[tuple[str, str], ...]:
    """Each escaped character and what stands for it; the backslash itself goes first when escaping, last when reading."""
    return tuple((c, "\\" + LETTERS.get(c, f"u{ord(c):x};")) for c in dict.fromkeys(("\\", *characters)))


def escapes(template: dict) -> tuple[tuple, tuple]:
    """The rules for texts and for roles, from the template's strings; a template that cannot be read back raises."""
    head, mid, tail = (template[k] for k in ("head", "mid", "tail"))
    if not mid or not tail or any(s[0].isalnum() or s[0] in "\\;" for s in (head, mid, tail) if s):
        raise ValueError("mid and tail must not be empty, and no string may begin with a letter, a digit, a semicolon or a backslash")
    for s in (head, mid):
        for i in range(len(s)):
            # What begins inside the string and runs on into a role or a text could be the end of a turn.
            if tail.startswith(s[i:]) or s[i:].startswith(tail):
                raise ValueError(f"the end of a turn could begin in {s!r}")
    first = [tail[0], *head[:1]]
    return _rules(*first), _rules(*first, mid[0], "\n")


def escape(text: Column, rules: tuple) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def unescape(text: Column, rules: tuple) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[1]), F.lit(r[0])), reversed(rules), text)


def format_chats(turns: DataFrame, template: dict = TEMPLATE, following: dict = NEXT) -> DataFrame:
    """conv_id, formatted, segments (text, loss), valid, bad_turn (0-based, null if valid)."""
    of_text, of_role = escapes(template)
    blank = F.lit("")
    row = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    allowed = F.create_map(*(F.lit(x) for state, roles in following.items() for role in roles for x in (f"{state}\n{role}", True)))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def advance(a: Column, t: Column) -> Column:
        fits = F.coalesce(F.element_at(allowed, F.concat_ws("\n", a["state"], t["role"])), F.lit(False))
        bad = F.when(a["bad"].isNull() & ~fits, a["at"]).otherwise(a["bad"])
        return F.struct(t["role"].alias("state"), (a["at"] + 1).alias("at"), bad.alias("bad"))

    def emit(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template["head"]), escape(t["role"], of_role), F.lit(template["mid"]))
        return F.array(part(head, F.lit(False)), part(escape(t["text"], of_text), t["role"].isin(*template["loss"])), part(F.lit(template["tail"]), F.lit(False)))

    segments = F.flatten(F.transform("turns", emit))
    out = chats.select("conv_id", segments.alias("segments"), F.aggregate("turns", start, advance, lambda a: a["bad"]).alias("bad_turn"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", formatted.alias("formatted"), "segments", F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted conversation."""
    of_text, of_role = escapes(template)
    parts = F.split(formatted, re.escape(template["tail"]), -1)
    skip, mid = len(template["head"]) + 1, template["mid"]

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(skip))
        at = F.instr(body, F.lit(mid))
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(mid))
        return F.struct(unescape(role, of_role).alias("role"), unescape(text, of_text).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def loss_mask(segments: Column) -> Column:
    """Whether each turn's text is under the loss."""
    return F.transform(F.filter(segments, lambda s, i: i % 3 == 1), lambda s: s["loss"])


def read_loss(turns: Column, mask: Column) -> Column:
    """All text under the loss mask, of turns that were read back, in order."""
    marked = F.zip_with(turns, mask, lambda t, loss: F.when(loss, t["text"]))
    return F.array_join(marked, "")


def chat_digests(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Digests of what formatted conversations say when they are read back, and whether their turns are in order."""
    x = format_chats(turns, template).select("conv_id", "formatted", "valid", "bad_turn", read_turns(F.col("formatted"), template).alias("turns"), loss_mask(F.col("segments")).alias("mask"))
    x = x.withColumn("loss", read_loss(F.col("turns"), F.col("mask")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )
