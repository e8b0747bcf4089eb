"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role its marks, its loss flag and the states it may follow. Every turn
becomes up to three segments (opening, text, closing) with a loss flag each; control strings inside texts are
escaped by a backslash after their first character (and backslashes are doubled), which :func:`unescaped`
reverses exactly. Formatting works row by row with one window over the conversation for the order check;
reading back streams each conversation in turn order with constant memory, so no conversation is collected.

Defined results: null text is empty; a null role is the empty role name; roles outside the template are kept
between generic marks and never bear loss; turns with the same number are ordered by role and text, repeated rows
are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    opening: str
    closing: str
    loss: bool
    follows: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """Roles with their marks; ``^`` is the state before the first turn."""

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<s><<SYS>>", "<</SYS>></s>", False, ("^",)),
            "user": Turn("<s>[INST]", "[/INST]</s>", False, ("^", "system", "assistant")),
            "assistant": Turn("<s>", "</s>", True, ("user",)),
        }
    )
    other_open: str = "<s>[ROLE]"
    other_mid: str = "[/ROLE]"
    other_close: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")


DEFAULT = Template()


def escaped(text: Column, template: Template = DEFAULT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.controls:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else m[1], text, flags=re.S)


def format_turns(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, turn, role, in_order (the state machine accepts the step), segments (array of text, loss)."""
    role = F.coalesce("role", F.lit(""))
    base = conversations.select(
        "conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    previous = F.lag("role", 1, "^").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    body = escaped(F.col("text"), template)
    opening = F.concat(F.lit(template.other_open), escaped(F.col("role"), template), F.lit(template.other_mid))
    closing, loss, allowed = F.lit(template.other_close), F.lit(False), F.lit(False)
    for name, turn in template.turns.items():
        here = F.col("role") == name
        opening = F.when(here, F.lit(turn.opening)).otherwise(opening)
        closing = F.when(here, F.lit(turn.closing)).otherwise(closing)
        loss = F.when(here, F.lit(turn.loss)).otherwise(loss)
        allowed = F.when(here, F.col("previous").isin(*turn.follows)).otherwise(allowed)
    return base.withColumn("previous", previous).select(
        "conv_id",
        "turn",
        "role",
        allowed.alias("in_order"),
        F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(body.alias("text"), loss.alias("loss")),
            F.struct(closing.alias("text"), F.lit(False).alias("loss")),
        ).alias("segments"),
    )


def _reader(template: Template):
    by_marks = {(t.opening, t.closing): name for name, t in template.turns.items()}
    opens = sorted({t.opening for t in template.turns.values()}, key=len, reverse=True)

    def parse(text: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        if text.startswith(template.other_open):
            role, _, rest = text[len(template.other_open) :].partition(template.other_mid)
            return unescaped(role), unescaped(rest[: len(rest) - len(template.other_close)])
        for opening in opens:
            if text.startswith(opening):
                for (o, closing), name in by_marks.items():
                    if o == opening and text.endswith(closing) and not (closing == "</s>" and any(text.endswith(c) for _, c in by_marks if c != closing)):
                        return name, unescaped(text[len(opening) : len(text) - len(closing)])
        raise ValueError("not a formatted turn")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def finished():
            turns, whole, bearing, chars, size, wrong = state
            return now, turns, whole.hexdigest(), chars, bearing.hexdigest(), size, wrong

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "out_of_order"]
        for frame in frames:
            rows = []
            for conv, ok, segments in zip(frame["conv_id"], frame["in_order"], frame["segments"], strict=True):
                conv = None if pd.isna(conv) else conv
                if state is None or conv != now:
                    if state is not None:
                        rows.append(finished())
                    now, state = conv, [0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                role, text = parse("".join(s["text"] for s in segments))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                for s in segments:
                    state[4] += len(s["text"])
                    if s["loss"]:
                        plain = unescaped(s["text"])
                        state[2].update(plain.encode())
                        state[3] += len(plain)
                state[5] += not ok
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if state is not None:
            yield pd.DataFrame([finished()], columns=columns)

    return read


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, computed from the formatted turns alone."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segments").select("conv_id", "in_order", "segments")
    return ordered.mapInPandas(
        _reader(template),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, out_of_order long",
    )
