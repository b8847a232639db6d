r"""Operator 8: chat formatting with spans located by incremental black-box rendering.

A template is any function from a list of turns to a string. `locate` renders successive prefixes of a
conversation and compares consecutive outputs: what a prefix adds is the span of its last turn. A template
that rewrites what it rendered before shows as an output that does not begin with the previous one; `locate`
then reports the turn, and spans begin after the common beginning. Whole prefixes are rendered, so the work grows
with the square of the turns. Only a template whose attribute `local` says that it renders each turn by itself is
rendered in stretches of at most STRETCH turns, each after the turn before it, which gives the same spans in a time
that grows in proportion to the turns; where a stretch does not begin with what its first turn gave as last turn of
the stretch before, that counts as a rewrite too.

`FencedTemplate` marks turns with control strings and escapes the characters they are made of inside texts
and roles, reversibly: no text, not even one that holds control strings or escapes, can pose as a mark.

Null text counts as empty, null role as ''. Turns are taken by turn number, ties by role, then text; null turn
numbers come first. Repeated rows are turns of their own. Rows without conv_id form one conversation (null).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import arrow_schema, bounded, columns_of

STRETCH = 32


class Turn(NamedTuple):
    role: str
    text: str


class Span(NamedTuple):
    """What a turn added to the output: its rendering, and whether rendering it changed earlier output."""

    turn: Turn
    added: str
    rewrote: bool


class FencedTemplate:
    r"""`### role:` line, text, `</turn>` line for each turn. `\`, `#`, `<` and a role's `:` and line end are escaped."""

    _escapes = {"\\": "\\b", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
    _back = {v[1]: k for k, v in _escapes.items()}
    _turn = re.compile(r"### ([^\n:]*):\n(.*?)</turn>\n", re.S)
    #: the rendering of turns is that of each turn by itself, joined
    local = True

    def escape(self, text: str, marks: str = "\\#<") -> str:
        return re.sub(f"[{re.escape(marks)}]", lambda m: self._escapes[m[0]], text) if any(c in text for c in marks) else text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: self._back[m[1]], text) if "\\" in text else text

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(f"### {self.escape(t.role, '\\#<:\n')}:\n{self.escape(t.text)}</turn>\n" for t in turns)

    def read(self, rendered: str) -> list[Turn]:
        """The turns that a string of whole turns was rendered from; fails if it is no such string."""
        turns, at = [], 0
        while at < len(rendered):
            m = self._turn.match(rendered, at)
            if not m:
                raise ValueError(f"no turn at {at}: {rendered[at : at + 40]!r}")
            turns.append(Turn(self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return turns


def locate(turns: Iterable[Turn], render: Callable[[list[Turn]], str], stretch: int = STRETCH) -> Iterator[Span]:
    """Spans of a conversation's turns in order. Holds `stretch` turns at most of a local template, all of any other."""
    local = getattr(render, "local", False)
    seen: list[Turn] = []
    output = last = ""
    for turn in turns:
        moved = False
        if local and len(seen) == stretch:
            seen = seen[-1:]
            output = render(seen)
            moved = output != last
        seen.append(turn)
        longer = render(seen)
        kept = len(output) if longer.startswith(output) else len(os.path.commonprefix((output, longer)))
        yield Span(turn, longer[kept:], moved or kept < len(output))
        output, last = longer, longer[kept:]


def format_turns(df: DataFrame, template=None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id long, at long (0, 1, ...), begins long, added string, rewrote boolean.

    `added`, in order of `at`, makes up the conversation's formatted text, in which it begins at `begins`.
    """
    template = template or FencedTemplate()
    schema = "conv_id long, at long, begins long, added string, rewrote boolean"
    arrow = arrow_schema(schema)

    def task(batches):
        def rows():
            for batch in bounded(batches, 2):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out, size = [], 0
        for conv, spans in _conversations(rows(), template):
            begins = 0
            for at, span in enumerate(spans):
                out.append((conv, at, begins, span.added, span.rewrote))
                begins += len(span.added)
                size += len(span.added)
                if size > 1 << 22 or len(out) >= 5000:
                    yield columns_of(arrow, dict(zip(arrow.names, zip(*out, strict=True), strict=True)))
                    out, size = [], 0
        if out:
            yield columns_of(arrow, dict(zip(arrow.names, zip(*out, strict=True), strict=True)))

    return _by_conversation(df, conv_col, turn_col, role_col, text_col).mapInArrow(task, schema)


def _by_conversation(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _conversations(rows: Iterable[tuple], template) -> Iterator[tuple]:
    """(conv_id, its spans) of rows sorted by conversation."""
    from itertools import groupby

    for conv, turns in groupby(rows, key=lambda r: r[0]):
        yield conv, locate((Turn(r[1], r[2]) for r in turns), template)


def digests(df: DataFrame, template=None, *, target: str = "assistant") -> DataFrame:
    """One row per conversation, read back from its formatted turns; texts of the role `target` are under the loss mask.

    A turn's span is read as it is rendered, and the digests grow by one turn at a time, so that a conversation
    of any length is never held whole.
    """
    template = template or FencedTemplate()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"
    arrow = arrow_schema(schema)

    def task(batches):
        def rows():
            for batch in bounded(batches, 2):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out = []
        for conv, spans in _conversations(rows(), template):
            turns, loss, n, chars, formatted, rewrites = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for span in spans:
                for turn in template.read(span.added):
                    turns.update(f"{turn.role}\n{turn.text}\n".encode())
                    n += 1
                    if turn.role == target:
                        loss.update(turn.text.encode())
                        chars += len(turn.text)
                formatted += len(span.added)
                rewrites += span.rewrote
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, rewrites))
            if len(out) >= 5000:
                yield columns_of(arrow, dict(zip(arrow.names, zip(*out, strict=True), strict=True)))
                out = []
        if out:
            yield columns_of(arrow, dict(zip(arrow.names, zip(*out, strict=True), strict=True)))

    return _by_conversation(df, "conv_id", "turn", "role", "text").mapInArrow(task, schema)


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """All `conversations` and the one numbered -7, formatted and read back."""
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(given.unionByName(more)).drop("rewrites")


#: `\`, `#` and `<` in a text and those and `:` and line ends in a role take one character more each; a turn has 14 besides.
ORACLE_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(14 + length(role) + length(text) + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::bigint as formatted_chars
from c group by conv_id
"""
