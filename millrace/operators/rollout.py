"""Rollouts: format gate, rewards, group-normalised advantages and the clipped objective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scoring import capped_reward
from millrace.functions.text import strict_format, two_lines

WINDOW, TARGET, LEAST, KEPT = 2096, 656, 64, 2032
CLIP, BETA = 0.2, 0.04


def clipped_prompt(ids: Column, kept: int = KEPT) -> Column:
    n = F.least(F.size(ids), F.lit(kept))
    return F.slice(ids, F.size(ids) - n + 1, n)


def generation_cap(prompt_n: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(TARGET), WINDOW - prompt_n - 1))


def gated(rollouts: DataFrame, *, answer: str = "answer", raw: str = "raw_reward") -> DataFrame:
    """reasoning, smiles, ok_format and reward of each reply."""
    ok, parts = strict_format(answer), two_lines(answer)
    return rollouts.withColumns({"ok_format": ok, "reasoning": parts["reasoning"], "smiles": parts["smiles"]}).withColumn("reward", capped_reward(F.col("ok_format"), F.col("smiles"), F.col(raw)))


def advantages(rewards: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """(reward - mean) / deviation within a group; the deviation (one degree less) is at least 1e-4, and a group of one has advantage 0."""
    rows = rewards.where(F.col(reward).isNotNull())
    moments = rows.groupBy(F.col(group).alias("_g")).agg(F.count(reward).alias("_n"), F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_std"))
    value = F.when(F.col("_n") < 2, 0.0).otherwise((F.col(reward) - F.col("_mean")) / F.greatest("_std", F.lit(1e-4)))
    return rows.join(moments, F.col(group).eqNullSafe(F.col("_g"))).withColumn("advantage", value).drop("_g", "_n", "_mean", "_std")


def candidates(answers: DataFrame, array: str, prompt: str) -> DataFrame:
    """A row for each candidate, keyed by prompt and its place; empty ones are left out."""
    out = answers.select("*", F.posexplode(array).alias("j", "candidate"))
    return out.where(F.trim("candidate") != "").drop(array)


def prompt_stats(rollouts: DataFrame, length: str) -> DataFrame:
    """Count, mean and largest of the prompts' lengths in a batch."""
    return rollouts.agg(F.count(length).alias("count"), F.avg(length).alias("mean"), F.max(length).alias("max"))


def spread(reward: Column, ids: Column) -> Column:
    return F.array_repeat(reward, F.size(ids))


def aligned(logps: Column, ids: Column) -> Column:
    """Log probabilities cut to the ids' length; zeros where there are none."""
    return F.coalesce(F.slice(logps, 1, F.size(ids)), F.array_repeat(F.lit(0.0), F.size(ids)))


def token_objective(logp: Column, old: Column, reference: Column, advantage: Column) -> Column:
    """Each token's loss: minus the clipped ratio times the advantage, plus the weighted divergence e^d - d - 1 from the reference."""
    rows = F.arrays_zip(logp.alias("l"), old.alias("o"), reference.alias("r"))

    def loss(t: Column) -> Column:
        ratio = F.exp(t["l"] - t["o"])
        gap = t["r"] - t["l"]
        gain = F.least(ratio * advantage, F.greatest(F.least(ratio, F.lit(1 + CLIP)), F.lit(1 - CLIP)) * advantage)
        return -(gain - BETA * (F.exp(gap) - gap - 1))

    return F.transform(rows, loss)


def masked_mean(values: Column, mask: Column) -> Column:
    """The mean over the mask; null for an empty mask, so that such rows leave the batch's mean."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    kept = total(F.zip_with(values, mask, lambda v, m: v * m.cast("double")))
    n = total(F.transform(mask, lambda m: m.cast("double")))
    return F.when(n > 0, kept / F.greatest(n, F.lit(1.0)))


def log_softmax_at(logits: Column, token: Column) -> Column:
    """The log probability of one entry of a logit array."""
    top = F.array_max(logits)
    spread_ = F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.get(logits, token) - top - spread_
