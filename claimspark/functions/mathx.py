"""Numeric column functions: logit, clipped sigmoid, deterministic draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SIGMOID_CLIP


def logit(p: float) -> float:
    return math.log(p / (1.0 - p))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-clip(x, -20, 20)))."""
    clipped = F.greatest(F.lit(-SIGMOID_CLIP), F.least(F.lit(SIGMOID_CLIP), x))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def hash_uniform(key: Column, seed: int) -> Column:
    """Uniform [0, 1) draw from md5(key || '|' || seed).

    Depends only on the key, never on partitioning or row order, so a lost
    executor that recomputes a partition redraws the same values.
    """
    h = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_uniform_sql(key_sql: str, seed: int) -> str:
    """The same draw in DuckDB SQL (used by oracle texts)."""
    return (f"(CAST(('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || '|{seed}'), 1, 8)) AS BIGINT)"
            f" / 4294967296.0)")
