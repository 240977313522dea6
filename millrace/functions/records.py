"""Records with open fields: field pickers, rewrites of molecule strings, alias spans, keyword quality."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import lenient_output, quality_score, stripped


def _named(record: Column, part: str) -> Column:
    """The first value that isn't blank among fields whose name contains a part."""
    entries = F.filter(F.map_entries(record), lambda e: F.contains(F.lower(e["key"]), F.lit(part)) & (stripped(F.coalesce(e["value"], F.lit(""))) != ""))
    return stripped(F.get(entries, F.lit(0))["value"])


def predicted_smiles(record: Column) -> Column:
    """Any field named for SMILES, else what the output field says."""
    return F.coalesce(_named(record, "smiles"), lenient_output(F.try_element_at(record, F.lit("output")))["smiles"], F.lit(""))


def optimized_smiles(record: Column) -> Column:
    """What the output field says, else any field named for SMILES."""
    return F.coalesce(F.nullif(lenient_output(F.try_element_at(record, F.lit("output")))["smiles"], F.lit("")), _named(record, "smiles"), F.lit(""))


def record_reasoning(record: Column) -> Column:
    return F.coalesce(F.nullif(lenient_output(F.try_element_at(record, F.lit("output")))["reasoning"], F.lit("")), _named(record, "reasoning"), F.lit(""))


#: What the rewrites of a molecule take out, and the names that are searched as whole words.
VARIANT_CUTS = (r"\s+", r"[@/\\]", r"\[[^\]]+\]", r"\(\)")
PLAIN_ALIAS = r"[a-z0-9][a-z0-9 _\-]*[a-z0-9]"


def smiles_variants(c: str | Column) -> Column:
    """Rewrites to try for a molecule that isn't found: without white space, stereo marks, odd dashes, further
    components, bracket atoms or empty branches; each once, in that order; none for blank text."""
    s = stripped(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    without = lambda pattern: F.regexp_replace(s, pattern, "")
    space, stereo, bracket, empty = map(without, VARIANT_CUTS)
    forms = F.array(s, space, stereo, F.translate(s, "–—−", "---"), F.substring_index(s, ".", 1), bracket, empty)
    return F.filter(F.array_distinct(forms), lambda x: x != "")


def alias_spans(text: str | Column, alias: str) -> Column:
    """Starts (from 0) and ends of an alias in lower-cased text: every whole word for plain names, the first substring for others."""
    low, a = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), alias.lower()
    span = lambda at: F.struct(at.cast("int").alias("start"), (at + len(a)).cast("int").alias("end"))
    if not re.fullmatch(PLAIN_ALIAS, a):
        return F.when(F.contains(low, F.lit(a)), F.array(span(F.instr(low, a) - 1))).otherwise(F.array().cast("array<struct<start: int, end: int>>"))
    # The starts run on: each is the end of the hit before and the length of what stands between.
    parts = F.transform(F.split(low, rf"\b{re.escape(a)}\b", -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, n: F.struct((s["at"] + n + len(a)).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out"))
    return F.transform(F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda s: s["out"]), span)


#: The keyword lists of the quality score; entries count as often as they are listed.
PROBLEM_KEYWORDS = [
    "问题", "issue", "problem", "缺陷", "deficiency", "不足", "lack", "毒性", "toxicity", "毒性", "toxic", "副作用", "side effect",
    "代谢", "metabolism", "代谢稳定性", "metabolic stability", "渗透性", "permeability", "溶解度", "solubility",
    "清除率", "clearance", "半衰期", "half-life",
]
SOLUTION_KEYWORDS = [
    "优化", "optimize", "改进", "improve", "增强", "enhance", "降低", "reduce", "减少", "decrease", "提高", "increase",
    "修饰", "modify", "替换", "replace", "添加", "add", "去除", "remove", "避免", "avoid", "防止", "prevent",
]
CHEMICAL_KEYWORDS = [
    "官能团", "functional group", "基团", "group", "原子", "atom", "键", "bond", "环", "ring", "芳香", "aromatic", "脂肪", "aliphatic",
    "极性", "polar", "非极性", "nonpolar", "氢键", "hydrogen bond", "分子量", "molecular weight", "logp", "logd", "tpsa",
]
STRATEGY_KEYWORDS = [
    "策略", "strategy", "方法", "method", "途径", "approach", "设计", "design", "合成", "synthesis", "修饰", "modification",
    "结构", "structure", "构效关系", "structure-activity", "药效团", "pharmacophore", "先导化合物", "lead compound",
]


def reasoning_quality(c: str | Column) -> Column:
    return quality_score(c, [PROBLEM_KEYWORDS, SOLUTION_KEYWORDS, CHEMICAL_KEYWORDS, STRATEGY_KEYWORDS])
