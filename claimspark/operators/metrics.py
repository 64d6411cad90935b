"""Binary-classification metrics as distributed aggregations (AGG-8..13).

ROC AUC and average precision need running sums over the score order. They
are computed on the table pre-aggregated by distinct score, and the running
sums never put the whole table in one task: the table is range-partitioned by
(group, score), as many ranges as its rows ask for; range totals give the
offsets, and the running sum within a range is a window partitioned by range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

#: Distinct (group, score) rows of one range: what a task sorts to sum over.
ROWS_PER_RANGE = 250_000


def score_counts(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Positives and negatives per (group, distinct score): map-side combined."""
    y = F.col(label).cast("long")
    return (df.groupBy(group, F.col(score).alias("score"))
              .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))


def prefix_counts(counts: DataFrame, group: str, n_buckets: int | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``pos_below``/``neg_below``: totals over strictly lower scores.

    The rows are range-partitioned by (group, score) into as many ranges as
    their number asks for, or ``n_buckets``. Each range is summed by itself,
    beginning at the totals of the group's ranges before it.
    """
    if n_buckets is None:
        n_buckets = max(1, -(-counts.count() // rows_per_range))
    # written, so that a lost task finds each row in the range that its offset was summed for
    ranged = (counts.repartitionByRange(n_buckets, group, "score")
                    .withColumn("range", F.spark_partition_id()).checkpoint(eager=True))
    totals = ranged.groupBy(group, "range").agg(F.sum("pos").alias("rpos"), F.sum("neg").alias("rneg"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a range and group meet in at most n_buckets + groups rows, one for rows_per_range scores
    offsets = totals.select(group, "range",
                            F.coalesce(F.sum("rpos").over(before), F.lit(0)).alias("off_pos"),
                            F.coalesce(F.sum("rneg").over(before), F.lit(0)).alias("off_neg"))
    within = Window.partitionBy(group, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", F.coalesce(F.sum("pos").over(within), F.lit(0)).alias("lpos"),
                          F.coalesce(F.sum("neg").over(within), F.lit(0)).alias("lneg"))
    same = F.col("l.range").eqNullSafe(F.col("o.range")) & F.col(f"l.{group}").eqNullSafe(F.col(f"o.{group}"))
    return (local.alias("l").join(offsets.alias("o"), same)
                 .select(f"l.{group}", "score", "pos", "neg",
                         (F.col("off_pos") + F.col("lpos")).alias("pos_below"),
                         (F.col("off_neg") + F.col("lneg")).alias("neg_below")))


def roc_auc_ap(df: DataFrame, group: str = "split", score: str = "score",
               label: str = "denial_label") -> DataFrame:
    """Tie-aware ROC AUC (Mann-Whitney) and average precision per group."""
    # the distinct-score table feeds three steps (number of rows, prefix sums,
    # totals): compute it once and cut its lineage with a reliable checkpoint
    counts = score_counts(df, group, score, label).checkpoint(eager=True)
    pc = prefix_counts(counts, group)
    # one row per group: bounded, broadcast
    tot = counts.groupBy(group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pc = pc.join(F.broadcast(tot), group)
    pos_above = F.col("P") - F.col("pos_below")
    neg_above = F.col("N") - F.col("neg_below")
    return (pc.groupBy(group).agg(
        # null where a group has one class only
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))), F.first("P") * F.first("N")).alias("auc"),
        F.try_divide(F.sum(F.try_divide(F.col("pos") * pos_above, pos_above + neg_above)), F.first("P")).alias("ap"))
        .select(group, F.round("auc", 4).alias("auc_roc"), F.round("ap", 4).alias("avg_precision")))


def confusion(df: DataFrame, group: str = "split", score: str = "score", label: str = "denial_label",
              threshold: float = K.METRIC_THRESHOLD) -> DataFrame:
    """AGG-8: tp/fp/tn/fn with predicted positive at score >= threshold."""
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    c = lambda cond: F.sum(cond.cast("long"))
    return df.groupBy(group).agg(c(pred & y).alias("tp"), c(pred & ~y).alias("fp"),
                                 c(~pred & ~y).alias("tn"), c(~pred & y).alias("fn"))


def f1_precision_recall(conf: DataFrame, group: str = "split") -> DataFrame:
    """AGG-11: zero division gives 0; rounded to 4 places."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return conf.select(group, F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"),
                       F.round(f1, 4).alias("f1"))


def split_summary(df: DataFrame, label: str = "denial_label") -> DataFrame:
    """AGG-13: sizes and label rates per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_denied"),
                                   F.round(F.avg(F.col(label).cast("double")), 6).alias("denial_rate"))


def class_weights(df: DataFrame, label: str = "denial_label") -> DataFrame:
    """AGG-12: neg/pos ratio and balanced weights n / (2 * n_class)."""
    y = F.col(label)
    agg = df.agg(F.sum((y == 1).cast("long")).alias("n_pos"), F.sum((y == 0).cast("long")).alias("n_neg"))
    n = F.col("n_pos") + F.col("n_neg")
    return agg.select("n_pos", "n_neg",
                      F.round(F.try_divide("n_neg", "n_pos"), 6).alias("scale_pos_weight"),
                      F.round(F.try_divide(n, 2 * F.col("n_pos")), 6).alias("weight_pos"),
                      F.round(F.try_divide(n, 2 * F.col("n_neg")), 6).alias("weight_neg"))


def with_class_weight(df: DataFrame, label: str = "denial_label", out: str = "weight") -> DataFrame:
    """Balanced per-row weight; the two class counts come from one aggregate."""
    row = df.agg(F.sum((F.col(label) == 1).cast("long")), F.count(F.lit(1))).first()
    n_pos, n = int(row[0] or 0), int(row[1] or 0)
    n_neg = n - n_pos
    wp = n / (2.0 * n_pos) if n_pos else 1.0
    wn = n / (2.0 * n_neg) if n_neg else 1.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(wp)).otherwise(F.lit(wn)))


def decisions(df: DataFrame, prob: str = "prediction_prob") -> DataFrame:
    """COND-9: action DENY if p > 0.5; risk HIGH >= .7, MEDIUM >= .4, else LOW."""
    p = F.col(prob)
    return df.withColumns({
        "recommended_action": F.when(p > K.DENY_THRESHOLD, "DENY").otherwise("APPROVE"),
        "denial_risk_level": F.when(p >= K.RISK_HIGH, "HIGH").when(p >= K.RISK_MEDIUM, "MEDIUM").otherwise("LOW"),
    })
