"""Exact duplicates, safe against groups of any size.

Texts are equal when the same characters remain after white space is deleted.
Each stage compares the whole remaining text, not only its digest:

1. local: Spark's map-side aggregation combines equal texts of one task;
2. salted: equal texts meet by (digest, salt), so that a text that a third of
   all rows share is combined by ``SALTS`` tasks;
3. global: the few winners of the salts meet by digest.

Every row then finds its group by SHA-256. Should two different texts ever
share one, stage 3 sees both and the job fails instead of merging them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
#: White space, as characters to delete: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
_WIDE = "decimal(38,0)"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _number(n: int) -> Column:
    return F.lit(Decimal(n)).cast(_WIDE)


def _rank(chars: Column, doc_id: Column) -> Column:
    """One number that is greatest for the most code points, then the smallest id (no id comes last).

    A number of fixed width stays in Spark's hash aggregation.
    """
    return (chars.cast(_WIDE) * _number(1 << 65) + F.coalesce(_number(1 << 63) - doc_id.cast(_WIDE), _number(0))).cast(_WIDE)


def _rank_id(rank: Column) -> Column:
    rest = rank % _number(1 << 65)
    return F.when(rest > 0, (_number(1 << 63) - rest).cast("long"))


def groups(docs: DataFrame) -> DataFrame:
    """One row per distinct text: ``digest, best`` (the rank of the row that stays), ``n``."""
    norm = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(
        F.unhex(F.sha2(norm, 256)).alias("digest"), norm.alias("norm"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"),
        _rank(F.length(F.coalesce("text", F.lit(""))), F.col("doc_id")).alias("best"))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    texts = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    clash = F.assert_true(F.count("*") == 1, "two texts share a SHA-256 digest")
    return texts.groupBy("digest").agg(F.max("best").alias("best"), F.max("n").alias("n"), clash.alias("clash"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty, and so equals any text of white space alone. A
    null id is kept only if no other row of its group has as many code points
    and an id. Of rows that share the kept id and are equally long, one is
    ``kept``. Other columns of ``docs`` are not read; an empty table gives none.
    """
    norm = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select(
        "doc_id", F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    copy = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy(F.desc("chars")))
    numbered = rows.withColumn("copy", copy)
    joined = numbered.join(groups(docs), "digest")
    keep = _rank_id(F.col("best"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 1) & F.col("clash").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that ``exact_dedup`` doesn't keep."""
    digest = F.unhex(F.sha2(normalised(F.col("doc.text").cast("string")), 256))
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc", F.col("doc.doc_id").cast("long").alias("id"), digest.alias("of"), F.length(F.coalesce(F.col("doc.text").cast("string"), F.lit(""))).alias("chars"))
    winners = groups(docs).select("digest", _rank_id(F.col("best")).alias("keep_id"), "clash")
    found = rows.join(winners, (rows["of"] == winners["digest"]) & rows["id"].eqNullSafe(winners["keep_id"])).filter("clash IS NULL")
    copy = F.row_number().over(Window.partitionBy("of", "id").orderBy(F.desc("chars")))
    return found.withColumn("copy", copy).filter("copy = 1").select("doc.*")
