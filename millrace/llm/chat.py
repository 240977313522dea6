"""Chat formatting with a template taken as a black box.

A template is any function from turns to text. Each prefix of a conversation's turns is rendered, and a turn's
span is what its prefix adds to the one before; if a render doesn't begin with the render before it, the template
rewrites history, and the conversation is marked. Where a turn's own text lies within its span is found by two more
renders with one-letter texts: what they share at either end is the template's.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bound_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: What the template itself writes, apart from roles; inside texts these are escaped.
CONTROLS = ("</s>", "<s>", "[/INST]", "[INST]", "<</SYS>>", "<<SYS>>", "<</ROLE>>", "<<ROLE ")
_CONTROL = re.compile(r"\\|(?=" + "|".join(map(re.escape, CONTROLS)) + r")[<\[]")
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", ">": "\\g"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_ESCAPED = re.compile(r"\\(.)", re.S)


#: Texts whose escaped forms are kept, and their characters at most: 16 MB or so in all.
KEPT, KEPT_CHARS = 4096, 4096


def _escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: _ESCAPES[m[0]], text)


_kept_escape = lru_cache(KEPT)(_escaped)


def escape(text: str) -> str:
    """Backslashes doubled, and the first character of each control string named by a letter."""
    return _kept_escape(text) if len(text) <= KEPT_CHARS else _escaped(text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def inst_template(turns: list[Turn]) -> str:
    """<s>, then [INST] text [/INST] for a user, text </s> for an assistant, and named brackets for a system or any other role."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)} </s>")
        elif role == "system":
            out.append(f"<<SYS>> {escape(text)} <</SYS>>")
        else:
            out.append(f"<<ROLE {escape(role).replace('>', _ESCAPES['>'])}>> {escape(text)} <</ROLE>>")
    return "".join(out)


_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>|<<ROLE (?P<role>.*?)>> (?P<other>.*?) <</ROLE>>| (?P<assistant>.*?) </s>", re.S)


def read_inst(formatted: str) -> list[Turn]:
    """The turns of an inst_template output."""
    if not formatted.startswith("<s>"):
        raise ValueError("not in this format")
    turns, at = [], len("<s>")
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
        at = m.end()
    return turns


def _shared(a: str, b: str, known: str) -> int:
    """Length of the common prefix; both usually begin with what is known, which then isn't gone through again."""
    skip = len(known) if a.startswith(known) and b.startswith(known) else 0
    return skip + len(os.path.commonprefix([a[skip:], b[skip:]]))


def locate(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The render of all turns; each turn's span and text bounds in it; whether a render rewrote the one before (then no spans)."""
    before, spans = template([]), []
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            return template(turns), [], True
        one, two = (template([*turns[:k], (role, x)]) for x in "xy")
        lead = _shared(one, two, before)
        tail = len(one) - lead - 1
        spans.append((len(before), len(now), lead, len(now) - tail))
        before = now
    return before, spans, False


def format_chats(conversations: DataFrame, *, template: Template = inst_template, trained: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, spans (role, start, end: code points), loss (start, end of the trained roles' texts), rewrites.

    Turns go by number, of equal numbers by role and text; a null text, role or number counts as empty, empty and first;
    rows with a null conv_id are one conversation; repeated rows are turns of their own; texts of any length go whole;
    an empty table gives no row. A conversation's rows come to one task, sorted by Spark, as each prefix needs the
    ones before, and it is rendered as often as it has turns: work goes with the square of its turns, so give rows that
    are no conversation ids of their own. Other columns are not read.
    """
    bound_batches(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    span = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def formatted(conv: int | None, turns: list[Turn]) -> tuple:
        out, spans, rewrites = locate(template, turns)
        roles = [r for r, _ in turns]
        marked = [{"role": r, "start": a, "end": b} for r, (a, b, _, _) in zip(roles, spans, strict=False)]
        return conv, out, marked, [{"start": c, "end": d} for r, (_, _, c, d) in zip(roles, spans, strict=False) if r in trained], rewrites

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), span, loss, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "formatted", "spans", "loss", "rewrites"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, out, size = None, [], [], 0
        for b in batches:
            for c, role, said in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if turns and c != conv:
                    out.append(formatted(conv, turns))
                    size += len(out[-1][1])
                    turns = []
                    if size > 4 << 20:
                        yield batch(out)
                        out, size = [], 0
                conv = c
                turns.append((role, said))
        if turns:
            out.append(formatted(conv, turns))
        if out:
            yield batch(out)

    schema = "conv_id long, formatted string, spans array<struct<role: string, start: long, end: long>>, loss array<struct<start: long, end: long>>, rewrites boolean"
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def chat_digests(chats: DataFrame, *, read: Callable[[str], list[Turn]] = read_inst) -> DataFrame:
    """The columns of the contract, read back from the formatted texts and their loss masks."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, out, loss in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss")), strict=True):
                turns = read(out)
                said = "".join(unescape(out[p["start"] : p["end"]]) for p in loss)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(out)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select("conv_id", "formatted", "loss").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
