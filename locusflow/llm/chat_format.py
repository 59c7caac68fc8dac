"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. Nothing is
assumed about it: successive prefixes of a conversation are rendered and consecutive
outputs compared. What one more turn appends is that turn's span; an output that does not
start with the previous one reveals a template that rewrites its history. Two probe texts
in place of the turn's own text show where, inside the span, the text stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

TURN_START, TURN_END, ESCAPE = "<|turn|>", "<|end|>", "\\"
#: Strings with a meaning for this or for common other templates; none of them survives inside a text.
CONTROLS = (TURN_START, TURN_END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
            "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
SCHEMA = (
    "conv_id bigint, formatted string, rewrites_history boolean, "
    "spans array<struct<turn:bigint, role:string, start:int, end:int, text_start:int, text_end:int>>"
)


def escape(text: str) -> str:
    """Double every backslash and break every control string with one; ``unescape`` reverts it."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", ESCAPE + "\n")


def unescaped(column: Column) -> Column:
    return F.regexp_replace(column, r"(?s)\\(.)", "$1")


def marked_turns(turns: Turns) -> str:
    """The default template: every turn between its own marks, control strings escaped."""
    return "".join(f"{TURN_START}{escape_role(r)}\n{escape(t)}{TURN_END}\n" for r, t in turns)


def _text_bounds(template: Template, before: Turns, role: str, previous: str, delta: str) -> tuple[int, int]:
    """Where the text stands in ``delta``, from the outputs of two texts that share nothing."""
    one, two = (template([*before, (role, probe)])[len(previous):] for probe in ("a", "b"))
    head = len(commonprefix([one, two]))
    tail = len(commonprefix([one[head:][::-1], two[head:][::-1]]))
    return min(head, len(delta)), max(min(head, len(delta)), len(delta) - tail)


def render_turns(template: Template, turns: Turns) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The whole output, a (start, end, text_start, text_end) for each turn, and whether history was rewritten.

    Every prefix is rendered whole, however long the conversation: a template may act on
    turns of any age, and no shorter rendering shows that it does not. The work grows with
    the square of a conversation's turns. A rewritten history leaves the last output, with
    spans that are its changed tails.
    """
    out, spans, rewritten = "", [], False
    for i, (role, text) in enumerate(turns):
        before = turns[:i]
        now = template(turns[: i + 1])
        if now.startswith(out):
            at, delta = len(out), now[len(out):]
            head, tail = _text_bounds(template, before, role, out, delta)
        else:
            rewritten = True
            at = len(commonprefix([now, out]))
            head, tail = 0, len(now) - at
        spans.append((at, len(now), at + head, at + tail))
        out = now
    return out, spans, rewritten


def _conversations(template: Template, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by conversation and turn; one conversation may cross batches."""

    def finish(conv, rows):
        turns = [(r, t) for _, r, t in rows]
        out, spans, rewritten = render_turns(template, turns)
        listed = [
            {"turn": n, "role": r, "start": a, "end": b, "text_start": c, "text_end": d}
            for (n, r, _), (a, b, c, d) in zip(rows, spans)
        ]
        return conv, out, rewritten, listed

    names = ["conv_id", "formatted", "rewrites_history", "spans"]
    key, rows, done = None, [], []
    for batch in batches:
        for conv, turn, role, text in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"]):
            conv, turn = None if pd.isna(conv) else int(conv), None if pd.isna(turn) else int(turn)
            if rows and conv != key:
                done.append(finish(key, rows))
                rows = []
            key = conv
            rows.append((turn, role or "", text or ""))
        if done:
            yield pd.DataFrame(done, columns=names)
            done = []
    if rows:
        yield pd.DataFrame([finish(key, rows)], columns=names)


def format_conversations(conversations: DataFrame, template: Template = marked_turns) -> DataFrame:
    """One row per conversation: the formatted text, its spans, and whether history was rewritten.

    Turns are ordered by ``turn`` (nulls first), equal turns by role and text. A null role
    or text is empty, a null ``conv_id`` is a conversation of its own, repeated rows are
    repeated turns, an empty table gives an empty result, other columns are ignored.
    A conversation is one output text, so one task holds that conversation and no other.
    """
    names = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role"), F.col("text")
    )
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions(*names)
        .mapInPandas(lambda batches: _conversations(template, batches), SCHEMA)
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Everything here is read back from the formatted text through the spans."""
    piece = lambda s, a, b: F.substring(F.col("formatted"), s[a] + 1, s[b] - s[a])
    role_part = lambda s: F.regexp_extract(
        piece(s, "start", "text_start"), r"(?s)^<\|turn\|>(.*)\n$", 1
    )
    turns = F.transform(
        "spans",
        lambda s: F.struct(
            unescaped(role_part(s)).alias("role"), unescaped(piece(s, "text_start", "text_end")).alias("text")
        ),
    )
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        formatted.withColumn("turns", turns)
        .withColumn("_said", said)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
            F.char_length("_said").cast("long").alias("loss_chars"),
            F.sha2(F.col("_said").cast("binary"), 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
            "rewrites_history",
        )
    )
