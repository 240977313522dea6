"""Many words found in one pass over a text: they become one pattern in the form of a trie, which matches the longest at a place."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import bound

#: A place where a whole word begins, and one where it ends.
BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _escaped(c: str) -> str:
    return c if c.isalnum() else rf"\x{{{ord(c):x}}}"


def trie_pattern(words: list[str]) -> str:
    """A pattern for any of the words; at a place it takes the longest that what follows allows."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        parts = [_escaped(c) + of(node[c]) for c in sorted(node) if c]
        inner = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")" if parts else ""
        return f"(?:{inner})?" if "" in node and inner else inner

    return of(root)


def longest_matches(text: Column, words: list[str], whole: bool) -> Column:
    """start (from 0) and word of every place where one of the words begins, the longest there; whole: only between word boundaries."""
    trie, most = trie_pattern(words), max(map(len, words))
    begin, end = (BEGIN, END) if whole else ("", "")

    def matches(t: Column) -> Column:
        # The text is cut before each match; where the pieces begin, words do, but for the first piece, which may hold none.
        pieces = F.transform(F.split(t, f"(?={begin}(?:{trie}){end})", -1), F.length)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(pieces, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        word = lambda at: F.regexp_extract(F.substring(t, at + 1, F.lit(most + 1)), f"^(?:{trie}){end}", 0)
        return F.filter(F.transform(starts, lambda at: F.struct(at.alias("start"), word(at).alias("word"))), lambda m: m["word"] != "")

    return bound(text, matches)


def within(words: list[str], whole: bool) -> dict[str, list[str]]:
    """Of each word, the words that begin where it does and end in it, itself among them."""
    known = set(words)
    ends = lambda w, k: not whole or k == len(w) or not re.match(r"\w", w[k])
    return {w: [w[:k] for k in range(1, len(w) + 1) if w[:k] in known and ends(w, k)] for w in known}

