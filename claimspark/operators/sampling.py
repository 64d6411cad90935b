"""Sampling and splitting (SMP-1..3).

Every draw is a hash of the claim id, so sample membership is the same for
any partitioning and survives recomputation after executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.mathx import hash_uniform


def sample_key(key: str = "claim_id", seed: int = K.SPLIT_SEED):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def uniform_sample(df: DataFrame, n: int, key: str = "claim_id", seed: int = K.SPLIT_SEED,
                   oversample: float = 4.0) -> DataFrame:
    """SMP-1: exactly the ``n`` rows with the smallest md5(key|seed), any partitioning.

    A plain ``orderBy(..).limit(n)`` merges n rows from every input partition
    in one task, which grows with the partition count. The sort key's first 8
    hex digits are the row's uniform draw u, so ``u < t`` keeps exactly the
    smallest keys: filter to about ``oversample * n`` candidates first, then
    sort those. If too few survive (very unlikely), fall back to the full sort.
    """
    keyed = df.withColumn("sample_key", sample_key(key, seed))
    total = df.count()
    if total > n:
        t = min(1.0, oversample * n / total)
        cand = keyed.filter(hash_uniform(F.col(key), seed) < t)
        if cand.count() >= n:
            return cand.orderBy("sample_key").limit(n)
    return keyed.orderBy("sample_key").limit(n)


def split_column(key: str = "claim_id", test_fraction: float = K.TEST_FRACTION,
                 seed: str = "split-42"):
    """SMP-2: 'test' when the claim's own uniform draw is below the fraction.

    The draw is independent of the label draw (a different salt), so each
    label class gets the same expected test share: stratified in
    expectation, with no shuffle and no per-class window.
    """
    u = hash_uniform(F.col(key), seed)
    return F.when(u < test_fraction, F.lit("test")).otherwise(F.lit("train"))


def with_split(df: DataFrame, **kw) -> DataFrame:
    return df.withColumn("split", split_column(**kw))


def background_stats(sample: DataFrame, cols: list[str]) -> DataFrame:
    """SMP-3: one row of per-column mean and std over a background sample."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return sample.agg(*aggs)
