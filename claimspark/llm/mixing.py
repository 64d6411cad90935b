"""Mixing sources to target weights by Sainte-Laguë apportionment, in SQL functions only.

* Targets: the sources share all words by weight; none gets more than
  ``repeats`` times its own words, and what it can't take is shared again by
  weight (solved at once over the sources sorted by cap / weight).
* Quotas: the words are counted in blocks of equal size. Blocks go to sources
  by the highest quotients target / (2k + 1); a source's blocks go on to its
  shards (about ``SHARD_DOCS`` documents dealt by hash) in the same way.
* Selection: a shard's documents stand in a seeded random order and are cut into
  blocks. A quota of several times the shard takes it whole so many times; the
  rest are blocks chosen by a seeded permutation of the block numbers. A
  document is taken as far as chosen blocks cover it.

Sources are few: what is computed over all of them has one row per source.
Whatever has a row per document is dealt by (source, shard).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, write_shared

WEIGHTS = (5, 2, 1)
REPEATS = 3
SHARD_DOCS = 2000
#: A prime above any number of blocks in a shard: multiplying by it permutes the block numbers.
PRIME = 2147483647


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    """60 random-looking bits of the parts (null: the word null)."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(by_source: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Add ``sid`` (by code point, null last), ``weight`` and ``target`` to ``source, source_size``."""
    n = len(weights)
    rows = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(n)) + 1).cast("int")))
    cap = F.lit(repeats) * F.col("source_size")
    order = Window.orderBy(cap / F.col("weight"), "sid")
    every = Window.partitionBy()
    capped_before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - capped_before) / weight_left)
    rows = rows.withColumn("full", cap / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return rows.withColumn("target", F.when(F.col("full"), cap.cast("double")).otherwise(F.col("weight") * level)).drop("level", "full")


def apportion(rows: DataFrame, within: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: add ``out``, the row's share of its group's ``seats`` by highest quotients votes / (2k + 1).

    ``seats`` is equal within a group; ties go to the smaller ``key``. For a
    group of C rows, rounding votes / divisor shows all but about 2 C of the
    highest quotients to be in; only those left over are listed and ranked.
    """
    group = Window.partitionBy(*within)
    v, n = F.col(votes).cast("double"), F.col(seats)
    total, half = F.sum(v).over(group), F.count("*").over(group) / 2
    sure = F.when(n > half, F.floor(v * (n - half) / total + 0.5) - 1).otherwise(F.lit(0))
    rows = rows.withColumn("__sure", F.when(v > 0, F.greatest(sure, F.lit(0))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("__most", F.when(v > 0, F.floor(v * (n + half) / total + 0.5) + 1).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("__left", n - F.sum("__sure").over(group))
    seat = F.explode(F.when(F.col("__most") > F.col("__sure"), F.sequence("__sure", F.col("__most") - 1)))
    listed = rows.select(*within, key, "__left", votes, seat.alias("__seat"))
    order = group.orderBy(F.desc(F.col(votes).cast("double") / (2 * F.col("__seat") + 1)), key)
    won = (listed.withColumn("__place", F.row_number().over(order)).filter("__place <= __left")
           .groupBy(*within, key).agg(F.count("*").alias("__won")))
    return (rows.join(won, [*within, key], "left").withColumn(out, F.col("__sure") + F.coalesce("__won", F.lit(0)))
            .drop("__sure", "__most", "__left", "__won"))


def block_words(total: int, least_target: float) -> int:
    """Words of a block: a 64th of the least target, at most 1024; not under 8 in corpora of over 8 million words."""
    low = min(8, max(1, total // 1_000_000))
    return int(max(low, min(1024, least_target // 64)))


def _placed(docs: DataFrame, digest: Column, weights, repeats: int, seed: int) -> tuple[DataFrame, int]:
    """Every document's place in its shard's seeded order and the shard's quota of words; and the words of a block.

    ``digest`` is carried along. The shard's ``words`` are ``passes`` times all
    of its own ``cell`` words and ``rest`` more; the document's stand from
    ``low`` to ``high``.
    """
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), digest.alias("digest"))
    sized = write_shared(sized, "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = source_targets(by_source, weights, repeats)
    least, total = sources.agg(F.min(F.when(F.col("target") > 0, F.col("target"))), F.sum("source_size")).first()
    block = block_words(total or 0, least or 1.0)

    sources = sources.withColumn("seats", F.lit(((total or 0) + block // 2) // block).cast("long")).withColumn("one", F.lit(1))
    sources = apportion(sources, ["one"], "sid", "target", "seats", "blocks")
    sources = sources.withColumn("shards", F.ceil(F.col("docs") / SHARD_DOCS)).withColumnRenamed("source", "of_source")
    sources = write_shared(sources.select("of_source", "sid", "source_size", "target", "blocks", "shards"), "quotas")

    rows = sized.join(sources, sized["source"].eqNullSafe(sources["of_source"]))
    rows = rows.withColumn("h", seeded(seed, F.col("doc_id"), F.col("size")))
    rows = rows.withColumn("shard", F.pmod("h", "shards"))
    cells = rows.groupBy("sid", "shard").agg(F.sum("size").alias("cell"), F.first("blocks").alias("seats"))
    cells = apportion(cells, ["sid"], "shard", "cell", "seats", "quota").select("sid", "shard", "cell", "quota")

    stream = Window.partitionBy("sid", "shard").orderBy("h", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(cells, ["sid", "shard"]).withColumn("low", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    b = F.lit(block).cast("long")
    words = F.least(F.col("quota") * b, F.lit(repeats) * F.col("cell"))
    rows = rows.withColumns({"high": F.expr("low + size"), "words": words})
    return rows.withColumns({"passes": F.expr("words div cell"), "rest": F.expr("words % cell")}), block


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``, and ``blocks`` its source's quota.

    ``taken`` counts the words the mix takes, repeats included: 0 to ``repeats``
    times ``size``. Null texts have no words; null is a source of its own; rows
    that share an id are documents of their own. An empty table gives none.
    Only ``doc_id``, ``text`` and ``source`` are read.
    """
    rows, block = _placed(docs, F.lit(0).cast("long"), weights, repeats, seed)
    b = F.lit(block).cast("long")
    rows = rows.withColumn("whole", F.expr(f"cell div {block}"))
    rows = rows.withColumns({"chosen": F.expr(f"rest div {block}"), "part": F.expr(f"rest % {block}")})
    rows = rows.withColumn("shift", F.pmod(F.col("sid") * 7919 + F.col("shard") * 104729 + seed, F.greatest("whole", F.lit(1))))

    def covered(got: Column, k: Column) -> Column:
        """Add the words of this document that block ``k`` takes."""
        start = k * b
        place = F.when(k < F.col("whole"), F.pmod(k * F.lit(PRIME).cast("long") + F.col("shift"), F.greatest("whole", F.lit(1)))).otherwise(F.col("whole"))
        end = start + F.when(place < F.col("chosen"), b).when(place == F.col("chosen"), F.col("part")).otherwise(F.lit(0))
        return got + F.greatest(F.least("high", end) - F.greatest("low", start), F.lit(0).cast("long"))

    some = F.aggregate(F.sequence(F.expr(f"low div {block}"), F.expr(f"(high - 1) div {block}")), F.lit(0).cast("long"), covered)
    taken = F.when(F.col("size") > 0, F.col("passes") * F.col("size") + F.when(F.col("rest") > 0, some).otherwise(F.lit(0))).otherwise(F.lit(0))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.cast("long").alias("taken"), "blocks")


def mixed(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """``docs`` as often as the mix takes them, in whole copies.

    A shard's quota is met by all its documents ``passes`` times, and once more
    by those that come first in its seeded order: up to the document whose middle
    the rest of the quota reaches. So a shard is off its quota by at most half
    a document, whatever the block size. Rows without words are left out. Rows
    equal in id, source and text are taken or left together.
    """
    rows, _ = _placed(docs, F.xxhash64(F.col("text").cast("string")), weights, repeats, seed)
    more = (F.expr("low + high") <= 2 * F.col("rest")).cast("int")
    copies = rows.filter("size > 0").withColumn("copies", F.col("passes") + more).groupBy("doc_id", F.col("of_source").alias("in_source"), "size", "digest").agg(
        F.round(F.avg("copies")).cast("int").alias("__copies")).filter("__copies > 0")
    source = docs.select(F.struct("*").alias("doc"))
    text = F.col("doc.text").cast("string")
    source = source.select("doc", F.col("doc.doc_id").cast("long").alias("__id"), F.col("doc.source").cast("string").alias("__source"), F.xxhash64(text).alias("__digest"))
    found = source.join(copies, source["__id"].eqNullSafe(copies["doc_id"]) & source["__source"].eqNullSafe(copies["in_source"])
                        & (source["__digest"] == copies["digest"]))
    return found.select("doc", F.explode(F.sequence(F.lit(1), "__copies"))).select("doc.*")
