"""What the operators of this folder share: inputs, shared tables, word hashes."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, ship_package

#: The white space that separates words: [\x20\x09-\x0D], as Java and DuckDB regular expressions write it.
SPACE = r"\x20\x09-\x0D"


def prepare(spark: SparkSession) -> str:
    """Ship the package to the executors and return the shared folder."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark).rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{prepare(spark)}/llm/{what}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts the lineage: whoever needs the rows again, also after an executor is
    lost, reads files that all executors see.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    w = df.write
    if codec:
        w = w.option("compression", codec)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WordHash(dict):
    """Word bytes -> 64-bit hash, remembered per Python worker up to ``limit`` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHash()
#: What a Python worker, which Spark uses again for later tasks, remembers between them.
MEMORIES: dict[str, dict] = {"words": WORDS}


def hold(name: str) -> None:
    """Empty the memories of this worker but the one named: it holds one at a time."""
    for other, memory in MEMORIES.items():
        if other != name:
            memory.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums evenly (a murmur-style finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
