"""Value parsing, feature rewards, set F-scores, novelty and judge blends as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import stripped


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Fixed value: numbers with their units.
_NUMBER = r"(?i)(?:[<>]=?|~)?\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*([munp]M|μM|%)?"


def unit_factor(unit: str | Column) -> Column:
    """To micromolar: mM 1000, nM 1/1000, pM 1/1e6; anything else as it is."""
    u = F.lower(_c(unit))
    return F.when(u == "mm", 1000.0).when(u == "nm", 1 / 1000.0).when(u == "pm", 1 / 1_000_000.0).otherwise(1.0)


def number_of(raw: str | Column) -> Column:
    """The first number with its unit taken to micromolar; without one the pluses less the minuses; null without either."""
    s = stripped(F.coalesce(_c(raw).cast("string"), F.lit("")))
    value = F.nullif(F.regexp_extract(s, _NUMBER, 1), F.lit("")).try_cast("double") * unit_factor(F.regexp_extract(s, _NUMBER, 2))
    plus, minus = (F.length(s) - F.length(F.replace(s, F.lit(x), F.lit(""))) for x in "+-")
    return F.coalesce(value, F.when((plus > 0) | (minus > 0), (plus - minus).cast("double")))


def band_distance(x: str | Column, lo: str | Column, hi: str | Column) -> Column:
    return F.greatest(_c(lo) - _c(x), _c(x) - _c(hi), F.lit(0.0))


#: Bonuses and penalties of a changed feature.
IMPROVED, CROSSED, ENTERED, RELATIVE = 2.0, 2.5, 3.5, 1.5
WORSENED, LOST, RELATIVE_LOSS, LARGEST = -1.5, -2.0, -1.2, 2.0
#: Four fifths of ENTERED, a fifth and half of WORSENED: products of doubles are off by a last bit, which shows where scores are rounded.
LEFT, LITTLE_WORSE, HALF_WORSE = -2.8, -0.3, -0.75


def feature_reward(orig: Column, opt: Column, direction: Column, lo: Column, hi: Column, threshold: Column, weight: Column, corrected: bool = False) -> Column:
    """Reward of a feature's change, within two weights of 0. direction: 1 more is better, -1 less, 0 a band, null none.

    The scoring rule multiplies a negative change by a negative weight, so a large loss is partly rewarded; corrected=True
    takes that term with the other sign.
    """
    sign = -1.0 if corrected else 1.0
    gain = direction * (opt - orig)
    ratio = F.abs(gain) / F.greatest(F.abs(orig), F.lit(0.1))
    up, down = direction == 1, direction == -1
    crossed = F.coalesce(F.when(up, (orig < threshold) & (opt >= threshold)).when(down, (orig > threshold) & (opt <= threshold)), F.lit(False))
    lost = F.coalesce(F.when(up, (orig >= threshold) & (opt < threshold)).when(down, (orig <= threshold) & (opt > threshold)), F.lit(False))
    # The levels of the ratio, and its cap.
    level = F.when(ratio < 0.05, LITTLE_WORSE).when(ratio < 0.15, HALF_WORSE).otherwise(WORSENED)
    better = IMPROVED + F.when(crossed, CROSSED).otherwise(0.0) + RELATIVE * F.least(ratio, F.lit(2.0))
    worse = level + F.when(lost, LOST).otherwise(0.0) - sign * RELATIVE_LOSS * F.least(ratio, F.lit(2.0))
    ordered = F.when(gain > 0, better).when(gain < 0, worse).otherwise(0.0)
    before, after = band_distance(orig, lo, hi), band_distance(opt, lo, hi)
    nearer = before - after
    moved = F.when(nearer > 0, RELATIVE * F.least(nearer, F.lit(2.0))).when(nearer < 0, -sign * RELATIVE_LOSS * F.least(-nearer, F.lit(2.0))).otherwise(0.0)
    banded = F.when((before > 0) & (after == 0), ENTERED).otherwise(0.0) + F.when((before == 0) & (after > 0), LEFT).otherwise(0.0) + moved
    raw = F.when(direction == 0, banded).when(direction.isNotNull(), ordered).otherwise(0.0)
    return F.greatest(F.least(raw * weight, LARGEST * weight), -LARGEST * weight)


def set_f_score(bad: str | Column, predicted: str | Column, reasoned: Column) -> Column:
    """Agreement of two feature sets: exact and one-sided matches by shares, others by F2 with floors."""
    b, q = F.size(_c(bad)).cast("double"), F.size(_c(predicted)).cast("double")
    t = F.size(F.array_intersect(_c(bad), _c(predicted))).cast("double")
    p, r = F.try_divide(t, q), F.try_divide(t, b)
    f2 = F.coalesce(F.try_divide(5 * p * r, 4 * p + r), F.lit(0.0))
    # Where precision and recall are cut, and the floors there.
    floored = F.when((p < 0.3) & (r > 0.5), F.greatest(f2, F.lit(0.3))).when((r < 0.3) & (p > 0.5), F.greatest(f2, F.lit(0.3))).when((p < 0.3) & (r < 0.3) & (t > 0), F.greatest(f2, F.lit(0.1))).otherwise(f2)
    return (
        F.when(~reasoned, 0.0).when(b == 0, F.when(q == 0, 1.0).otherwise(0.5)).when(q == 0, 0.0)
        .when((t == b) & (t == q), 1.0).when((t == q) & (q < b), t / b).when((t == b) & (b < q), t / q).otherwise(floored)
    )


def novelty(x: str | Column) -> Column:
    """Novelty of a normalised mean distance, in six tiers."""
    x = _c(x)
    # The tiers' cuts, and the line or curve in each.
    return (
        F.when(x < 0.5, 0.4 + 0.6 * x).when(x < 0.65, 0.7 + (x - 0.5) / 0.15 * 0.2)
        .when(x < 1.05, 0.9 + 0.1 * F.exp(-((x - 0.85) * (x - 0.85)) / (2 * 0.15 * 0.15)))
        .when(x < 1.3, 0.9 - (x - 1.05) / 0.25 * 0.3).when(x < 1.8, 0.6 - (x - 1.3) / 0.5 * 0.3)
        .otherwise(F.greatest(F.lit(0.1), 0.3 - (x - 1.8) * 0.05))
    )


def novelty_tier(x: str | Column) -> Column:
    x = _c(x)
    return F.when(x < 0.5, 1).when(x < 0.65, 2).when(x < 1.05, 3).when(x < 1.3, 4).when(x < 1.8, 5).otherwise(6)


#: The blend's weights, and below which a score is critical.
def judge_blend(rigor: str | Column, logic: str | Column) -> Column:
    return 0.40 * _c(rigor) + 0.60 * _c(logic)


def is_critical(rigor: str | Column, logic: str | Column, *flags: Column) -> Column:
    out = (_c(rigor) < 0.4) | (_c(logic) < 0.4)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def effect_label(d: str | Column) -> Column:
    a = F.abs(_c(d))
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def capped_reward(ok: Column, smiles: Column, reward: Column, bad: float = -2.0, most: float = 10.0) -> Column:
    """bad for a reply in the wrong format, without a molecule or a reward; else the reward within +-most."""
    return F.when(~ok | (F.coalesce(smiles, F.lit("")) == "") | reward.isNull() | F.isnan(reward), bad).otherwise(F.greatest(F.least(reward, F.lit(most)), F.lit(-most)))


#: Features that count for coverage, and weights other than 1.
CORE_FEATURES = (
    "Caco-2 Permeability", "F50%", "CYP3A4 inhibitor", "CYP2D6 inhibitor", "Pgp substrate", "hERG Blockers", "DILI",
    "Human Hepatotoxicity", "AMES Toxicity", "Genotoxicity", "Toxicity: Drug-induced Neurotoxicity", "QED", "SAScore",
    "GASA", "Lipinski Rule", "HLM Stability",
)
FEATURE_WEIGHTS = {
    "Genotoxicity": 3.0, "DILI": 3.0, "Carcinogenicity": 3.0, "AMES Toxicity": 2.5, "Human Hepatotoxicity": 2.5,
    "hERG Blockers": 2.0, "hERG Blockers (10 um)": 2.0, "Toxicity: Drug-induced Neurotoxicity": 2.0,
    "Toxicity: Drug-induced Nephrotoxicity": 2.0, "Hematotoxicity": 1.8, "Caco-2 Permeability": 1.5, "HIA": 1.5,
    "BBB": 1.5, "logS": 1.5, "PPB": 1.3, "Fu": 1.3,
}
#: Bands, and the features of which more, or less, is better.
BANDS = {"logP": (1.0, 3.0), "Topological Polar Surface Area (TPSA)": (20.0, 130.0), "Molecular Weight (MW)": (150.0, 500.0)}
MORE_IS_BETTER = ("HLM Stability", "logS", "logD7.4", "Flexibility", "Fsp3", "QED", "NPscore", "Caco-2 Permeability", "MDCK Permeability", "PAMPA", "Fu")
LESS_IS_BETTER = ("Human Hepatotoxicity", "Genotoxicity", "Carcinogenicity", "Eye Irritation", "Eye Corrosion", "Respiratory", "Skin Sensitization", "DILI", "AMES Toxicity", "PPB")
