"""Aliases of features: precedence, odd names, and their places in texts against a plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions.records import PLAIN_ALIAS
from millrace.functions.vocabulary import default_aliases
from millrace.operators.scoring import alias_hits, canonical_names, resolve_aliases


def plain_hits(rows, aliases):
    out = []
    for i, text in rows:
        low = (text or "").lower()
        for alias, canonical in aliases.items():
            if re.fullmatch(PLAIN_ALIAS, alias):
                spans = [m.span() for m in re.finditer(rf"\b{re.escape(alias)}\b", low)]
            else:
                at = low.find(alias)
                spans = [(at, at + len(alias))] if at >= 0 else []
            out += [(i, alias, canonical, *s) for s in spans]
    return sorted(out, key=str)


@pytest.mark.parametrize("pattern", [4096, 7])
def test_places_equal_plain_search(spark, monkeypatch, pattern):
    from millrace.operators import scoring

    monkeypatch.setattr(scoring, "PATTERN", pattern)
    rng = random.Random(4)
    known = list(default_aliases())[:60] + ["ames", "ames toxicity", "toxicity", "liver toxicity", "toxicity rule", "毒性", "肝毒性", "c-2", "a", "a b", "é", "(x", "x)", "cyp"]
    aliases = {a: f"<{a}>" for a in known}
    bits = [*known, "liver toxicity rule", "a b", "a_b", "aa", "é", "制", "ß", "²", ".", "\n", "ames-ames ames", "LIVER Toxicity"]
    rows = [(k, "".join(rng.choice(bits) + rng.choice(["", " ", " ", "-", "制", "_"]) for _ in range(rng.randint(0, 30)))) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "ames"), (902, "ames"), (903, "ames " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "alias": F.lit("x")})
    table = spark.createDataFrame(list(aliases.items()), "alias string, canonical string")
    got = sorted((tuple(r[c] for c in ("doc_id", "alias", "canonical", "start", "end")) for r in alias_hits(docs, table).collect()), key=str)
    assert got == plain_hits(rows, aliases)
    assert alias_hits(docs.limit(0), table).count() == 0


def test_alias_that_overlaps_itself_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b a b a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="overlap"):
        alias_hits(docs, spark.createDataFrame([("a b a", "x")], "alias string, canonical string"))


def test_later_blocks_replace_and_the_last_name_wins(spark):
    entries = [("A", "one", 0, 0), ("A", "gone", 1, 0), ("B", "two", 2, 0), ("B", "shared", 3, 0), ("C", " Three ", 4, 0), ("A", "shared", 5, 1), ("A", "one", 6, 1), ("D", "b", 7, 1)]
    got = {r["alias"]: r["canonical"] for r in resolve_aliases(spark.createDataFrame(entries, "canonical string, alias string, pos long, block int")).collect()}
    assert got == {"a": "A", "one": "A", "two": "B", "shared": "B", "three": "C", "c": "C", "b": "D", "d": "D"}


def test_names_of_a_full_table(spark):
    """Names that only a caller's table knows; of aliases with equal letters the last; letters of no alphabet known stay unknown."""
    entries = [("logP", "xlogp3", 0), ("Enzyme inhibitor", "酶 ez1", 1), ("Enzyme substrate", "ez1 底物", 2)]
    table = resolve_aliases(spark.createDataFrame(entries, "canonical string, alias string, pos long"))
    names = [("XLOGP3",), ("x-logp-3",), ("EZ1",), ("不明",), ("",), (None,), ("XLOGP3",)]
    got = {r["name"]: r["feature"] for r in canonical_names(spark.createDataFrame(names, "name string"), table).collect()}
    assert got == {"XLOGP3": "logP", "x-logp-3": "logP", "EZ1": "Enzyme substrate", "不明": "不明", "": "", None: None}
