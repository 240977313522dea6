"""Text expressions: tags, formats, sanity checks, splits and normalisers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip knows it.
_SPACE = r"(?U)^\s+|\s+$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), _SPACE, "")


def tag_line(c: str | Column, tag: str) -> Column:
    """What follows the first line that starts with the tag and an ASCII or full-width colon; empty without one."""
    return stripped(F.regexp_extract(_c(c), rf"(?im)^\s*{tag}\s*[:：]\s*(.*)$", 1))


#: Tags, and the patterns of the molecule that a prompt asks about and of a leniently read reply.
REASONING, SMILES = "Reasoning", r"Optimized[_\s-]*SMILES"
_ORIGINAL_TOKEN, _ORIGINAL_LINE = r"(?im)^\s*Original\s+SMILES\s*:\s*(\S+)", r"(?m)^\s*Original SMILES:(.*)$"
_LENIENT_REASONING = r"(?is)\breasoning\s*:\s*(.+?)(?:\n+\s*(?:optimized[_\s-]*smiles|smiles)\s*:|$)"
_LENIENT_TAGS = (r"optimized[_\s-]*smiles", "smiles")


def domain_output(text: str | Column, source: str | Column, smiles_only: bool = False) -> Column:
    """Two lines (or one) and <END> for the chem source: the last line of each tag, or the bare tag; trimmed text for others."""
    trimmed = stripped(F.coalesce(_c(text), F.lit("")))
    if smiles_only:
        chem = F.concat(F.lit("Optimized_SMILES: "), tag_line(trimmed, SMILES), F.lit("\n<END>"))
    else:
        own = F.transform(F.split(trimmed, r"\r\n|\r|\n"), lambda x: stripped(x))
        last = lambda tag, bare: F.coalesce(F.try_element_at(F.filter(own, lambda x: F.rlike(x, F.lit(rf"(?i)^\s*{tag}\s*:"))), F.lit(-1)), F.lit(bare))
        both = F.concat_ws("\n", last(REASONING, "Reasoning:"), last(SMILES, "Optimized_SMILES:"))
        chem = F.when(F.contains(both, F.lit("<END>")), both).otherwise(F.concat(both, F.lit("\n<END>")))
    return F.when(_c(source) == "chem", chem).otherwise(trimmed)


def prompt(system: str | Column, user: str | Column) -> Column:
    return F.concat(F.lit("System: "), F.coalesce(_c(system), F.lit("")), F.lit("\nUser: "), F.coalesce(_c(user), F.lit("")), F.lit("\nAssistant: "))


#: Fixed value: the strict format.
_TWO_LINES = r"(?is)^(?:.*?</THINK>\s*)?\s*Reasoning\s*:\s*([^\n]+?)\s*\n\s*Optimized_SMILES\s*:\s*(\S+?)\s*(?:</?END>)?\s*$"


def strict_format(c: str | Column) -> Column:
    """Whether a reply is exactly a reasoning line and a one-token SMILES line, scratchpad and end mark aside."""
    return F.rlike(F.coalesce(_c(c), F.lit("")), F.lit(_TWO_LINES))


def two_lines(c: str | Column) -> Column:
    """reasoning and smiles of a strictly formatted reply, else empty."""
    text = F.coalesce(_c(c), F.lit(""))
    return F.struct(stripped(F.regexp_extract(text, _TWO_LINES, 1)).alias("reasoning"), stripped(F.regexp_extract(text, _TWO_LINES, 2)).alias("smiles"))


def original_smiles(c: str | Column, variant: str = "token") -> Column:
    """The molecule a prompt asks about. token: first token of an `Original SMILES:` line, any case; colon: what follows
    the first line's first colon, or that line; line: the rest of the first line starting `Original SMILES:` exactly."""
    text = F.coalesce(_c(c), F.lit(""))
    if variant == "token":
        return F.regexp_extract(text, _ORIGINAL_TOKEN, 1)
    if variant == "colon":
        first = F.element_at(F.split(stripped(text), "\n"), 1)
        return stripped(F.when(F.contains(first, F.lit(":")), F.regexp_extract(first, r"(?s)^[^:]*:(.*)$", 1)).otherwise(first))
    if variant == "line":
        return stripped(F.regexp_extract(text, _ORIGINAL_LINE, 1))
    raise ValueError(variant)


def longest_component(smiles: str | Column) -> Column:
    """The first longest of the dot-separated molecules."""
    parts = F.filter(F.transform(F.split(_c(smiles), r"\."), lambda x: stripped(x)), lambda x: x != "")
    best = F.aggregate(parts, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.when(F.contains(_c(smiles), F.lit(".")), best).otherwise(_c(smiles))


def chosen_component(smiles: str | Column, strategy: str = "longest", score: Callable[[Column], Column] | None = None, valid: Callable[[Column], Column] | None = None) -> Column:
    """One of the dot-separated molecules: of the valid ones the first with the largest score, without a valid one the first longest.

    strategy: longest (the length), first (the place, so that the last valid one is taken), or any other name with a
    score given: a column function of a molecule, such as a UDF over a chemistry toolkit. valid: likewise, by default
    smiles_sane.
    """
    if strategy not in ("longest", "first") and score is None:
        raise ValueError(f"{strategy} needs a score")
    s = _c(smiles)
    parts = F.filter(F.transform(F.split(s, r"\."), lambda x: stripped(x)), lambda x: x != "")
    points = (lambda x, k: k.cast("double")) if strategy == "first" else (lambda x, k: (score(x) if score else F.length(x)).cast("double"))
    scored = F.filter(F.transform(parts, lambda x, k: F.when((valid or smiles_sane)(x), F.struct(points(x, k).alias("score"), (-k).alias("place"), x.alias("smiles")))), lambda x: x.isNotNull())
    several = F.coalesce(F.array_max(scored)["smiles"], longest_component(s))
    return F.when(~F.contains(s, F.lit(".")) | (F.size(parts) == 0), s).when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(several)


def lenient_output(c: str | Column) -> Column:
    """reasoning and smiles of a reply: reasoning up to the next SMILES tag or the end; the first token of the tagged
    line, without closing punctuation; of several molecules the longest. Nothing behind a tag gives an empty string."""
    text = F.regexp_replace(stripped(F.coalesce(_c(c), F.lit(""))), r"(?i)\s*<\s*end\s*>\s*$", "")
    reasoning = stripped(F.regexp_extract(text, _LENIENT_REASONING, 1))

    def tagged(tag: str) -> Column:
        rest = stripped(F.regexp_replace(stripped(F.regexp_extract(text, rf"(?im)^\s*{tag}\s*:\s*(.+)$", 1)), r"(?i)\s*<\s*end\s*>.*$", ""))
        token = F.regexp_extract(rest, r"^\S+", 0)
        return F.nullif(F.regexp_replace(token, r"^[.,;，；。]+|[.,;，；。]+$", ""), F.lit(""))

    smiles = F.coalesce(*map(tagged, _LENIENT_TAGS), F.lit(""))
    return F.struct(reasoning.alias("reasoning"), longest_component(smiles).alias("smiles"))


#: What a molecule is written with, and where sentences end.
MOLECULE, SENTENCE_END = r"^[A-Za-z0-9@+\-\[\]()=#$%/\\.:*]+$", r"[\n\.!?]\s+"


def smiles_sane(c: str | Column) -> Column:
    """Allowed characters only, parentheses balanced and never closed before opened, an even number of digits."""
    s = F.coalesce(_c(c), F.lit(""))
    marks = F.filter(F.split(s, ""), lambda x: (x == "(") | (x == ")"))
    depth = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")), lambda d, x: F.struct((d["now"] + F.when(x == "(", 1).otherwise(-1)).alias("now"), F.least(d["low"], d["now"] + F.when(x == "(", 1).otherwise(-1)).alias("low")))
    digits = F.length(s) - F.length(F.regexp_replace(s, "[0-9]", ""))
    return F.rlike(s, F.lit(MOLECULE)) & (depth["now"] == 0) & (depth["low"] == 0) & (digits % 2 == 0)


def sentences(c: str | Column, least: int = 8) -> Column:
    """Trimmed pieces between line ends or closing marks followed by white space, of at least that many characters."""
    return F.filter(F.transform(F.split(_c(c), SENTENCE_END), lambda x: stripped(x)), lambda x: F.length(x) >= least)


def reasoning_slice(c: str | Column, fallback: str | Column) -> Column:
    """The text behind the first `Reasoning:` up to its next occurrence or the first `Optimized_SMILES:`; else the fallback."""
    behind = F.get(F.split(F.coalesce(_c(c), F.lit("")), "Reasoning:"), F.lit(1))
    return F.coalesce(stripped(F.get(F.split(behind, "Optimized_SMILES:"), F.lit(0))), F.coalesce(_c(fallback), F.lit("")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once for each row, also where lambdas repeat it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _share_of(low: Column, keywords: list[str]) -> Column:
    hits = F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)))
    return F.least(hits / len(keywords) * 2, F.lit(1.0))


def keyword_score(c: str | Column, keywords: list[str]) -> Column:
    """Twice the share of the keywords that the lower-cased text contains, at most 1; a keyword listed twice counts twice."""
    return bound(F.lower(_c(c)), lambda low: _share_of(low, keywords))


def quality_score(c: str | Column, lists: list[list[str]]) -> Column:
    """The mean of the lists' keyword scores and a bonus for length, at most 1; 0 for blank text."""
    mean = bound(F.lower(_c(c)), lambda low: sum((_share_of(low, k) for k in lists), F.lit(0.0)) / len(lists))
    whole = F.least(mean + F.least(F.length(_c(c)) / 500, F.lit(0.2)), F.lit(1.0))
    return F.when(~F.rlike(F.coalesce(_c(c), F.lit("")), F.lit(r"(?U)\S")), 0.0).otherwise(whole)


def plain_key(c: str | Column) -> Column:
    """A property name without markup and with ASCII parentheses, lower-cased and trimmed."""
    return F.lower(stripped(F.translate(F.regexp_replace(_c(c), "<[^>]+>", ""), "（）", "()")))


def split_key(c: str | Column) -> Column:
    """The same with spaces between words, and between letters and digits."""
    s = F.translate(F.regexp_replace(_c(c), "<[^>]+>", ""), "（）", "()")
    for seam in (r"(?<=[A-Za-z])(?=[A-Z][a-z])", r"(?<=[A-Za-z])(?=\d)", r"(?<=\d)(?=[A-Za-z])"):
        s = F.regexp_replace(s, seam, " ")
    return s


def flat_key(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(_c(c), "[^0-9a-zA-Z]+", ""))


def vina_affinity(c: str | Column) -> Column:
    """The fourth token of the first result remark of a pose, as a number; 0 without one."""
    return F.coalesce(F.expr("0.0D") if c is None else F.regexp_extract(_c(c), r"(?m)^REMARK VINA RESULT:\s+(\S+)", 1).try_cast("double"), F.lit(0.0))


def json_in_text(c: str | Column, schema: str) -> Column:
    """The outermost braces of a reply, parsed; null where that fails."""
    return F.from_json(F.nullif(F.regexp_extract(_c(c), r"(?s)\{.*\}", 0), F.lit("")), schema)
