"""Training-log metrics (A8, K4; W4 lives with the scorer)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_epoch_loss(log: DataFrame, by: list[str], loss: str = "loss", ntokens: str = "ntokens",
                        elapsed: str = "elapsed") -> DataFrame:
    """``sum(loss) / sum(tokens)`` and tokens per second, over *all*
    batches (the reference returns after the first)."""
    return log.groupBy(*by).agg(
        (F.sum(loss) / F.sum(ntokens)).alias("loss_per_token"),
        (F.sum(ntokens) / F.sum(elapsed)).alias("tokens_per_sec"),
        F.count(F.lit(1)).alias("n_batches"))


def best_checkpoint(log: DataFrame, run: str = "run", metric: str = "eval_loss",
                    step: str = "step") -> DataFrame:
    """K4: per run the eval row with the lowest ``metric`` (ties: earliest step)."""
    ev = log.filter(F.col(metric).isNotNull())
    b = ev.groupBy(run).agg(F.min(F.struct(F.col(metric).alias("m"), F.col(step).alias("s"))).alias("b"))
    return b.select(run, F.col("b.s").alias("best_step"), F.col("b.m").alias(f"best_{metric}"))
