"""Policy-loss statistics over given log probabilities; nothing is differentiated.

``tokens``: one row per token with sequence_id, new_logprob, old_logprob (null: none), advantage, valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the variants, and other names they go by: T22.
VARIANTS = ("grpo", "dapo", "dr_grpo", "gspo", "sapo")
ALIASES = {"sequence": "gspo", "gspo-token": "gspo", "reinforce": "grpo"}


def variant(name: str) -> str:
    """T22."""
    found = ALIASES.get(name.strip().lower(), name.strip().lower())
    if found not in VARIANTS:
        raise ValueError(f"no such loss: {name!r}; there are {', '.join(VARIANTS)}")
    return found


def log_ratio() -> Column:
    """Without an old log probability the ratio is 1: T20."""
    return F.col("new_logprob") - F.coalesce("old_logprob", "new_logprob")


def old_logprobs(logged: Column, response: Column) -> Column:
    """The old log probabilities of a response's tokens; none at all where fewer were logged than it has: T20.

    What was logged beyond the response's end is left out.
    """
    n = F.size(response)
    return F.when(F.size(F.coalesce(logged, F.array())) >= n, F.slice(logged, F.lit(1), n))


def clipped(ratio: Column, advantage: Column, low: float, high: float) -> Column:
    return -F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high)) * advantage)


def _mean(x: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("valid"), x)), F.lit(0.0)) / F.greatest(F.sum(F.col("valid").cast("int")), F.lit(1))


def loss(tokens: DataFrame, name: str, low: float = 0.2, high: float = 0.2, alpha: float = 1.0, constant: float | None = None) -> DataFrame:
    """One row with the loss of a variant: T15-T18."""
    name, ratio, a = variant(name), F.exp(log_ratio()), F.col("advantage")
    if name in ("grpo", "dapo"):
        return tokens.agg(_mean(clipped(ratio, a, low, high)).alias("loss"))
    if name == "sapo":
        return tokens.agg(_mean(-(1 + F.tanh(alpha * (ratio - 1)) / alpha) * a).alias("loss"))
    if name == "gspo":
        per = tokens.groupBy("sequence_id").agg(F.exp(_mean(log_ratio())).alias("ratio"))
        return tokens.join(per, "sequence_id").agg(_mean(clipped(F.col("ratio"), a, low, high)).alias("loss"))
    sums = tokens.groupBy("sequence_id").agg(F.coalesce(F.sum(F.when(F.col("valid"), clipped(ratio, a, low, high))), F.lit(0.0)).alias("s"), F.sum(F.col("valid").cast("int")).alias("n"))
    by = F.greatest(F.lit(float(constant)) if constant is not None else F.max("n").cast("double"), F.lit(1.0))
    return sums.agg((F.avg("s") / by).alias("loss"))


def clip_fraction(tokens: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Share of valid tokens whose ratio is outside the band: T19."""
    ratio = F.exp(log_ratio())
    return tokens.agg(_mean(((ratio < 1 - low) | (ratio > 1 + high)).cast("double")).alias("clip_fraction"))


def floor_renormalised(p: Column, floor: float, total: Column) -> Column:
    """T14; ``total``: the sum of the floored probabilities of the candidates."""
    return F.greatest(p, F.lit(floor)) / total


def negative_loss(p: Column, weight: Column, eps: float = 1e-6) -> Column:
    """-weight * log(1 - p): T21."""
    return -weight * F.log1p(-F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))


def learning_rate(step: Column, base: float, total: int, warmup: int, floor: float) -> Column:
    """Rises linearly from floor * base to base, then falls back to it: T24.  ``floor`` 0 is the usual schedule."""
    up = floor + (1 - floor) * step / max(1, warmup)
    done = F.least(F.greatest((step - warmup) / max(1, total - warmup), F.lit(0.0)), F.lit(1.0))
    return base * F.when(step < warmup, up).otherwise(1 - (1 - floor) * done)
