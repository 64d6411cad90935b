"""Attributions for the label scorecard and the tables derived from them.

XAI-2 (scorecard form), XAI-3, XAI-4, AGG-5, WIN-2, WIN-4, MAP-1, SRT-1.

The scorecard is additive in eight terms, so its interventional Shapley
values have a closed form against a background distribution: a one-feature
term contributes ``w * (t(x) - E[t])``; the one two-feature term
``a(is_inpatient) * b(los_days)`` is split by the two-player Shapley rule.
The background is the whole table: its means are one aggregate row.
Per-claim work is then a projection; ranking the 36 values of a claim is an
array sort inside the row (no explode, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .label import scorecard_terms

FEATURE_INDEX = {f: i for i, f in enumerate(K.FEATURE_COLS)}
# single-feature terms -> the feature they belong to
_TERM_FEATURE = {
    "no_prior_auth": "prior_auth_present",
    "zero_or_neg_payment": "clm_pmt_amt",
    "vcode_primary": "primary_icd9_num",
    "high_cost": "clm_pmt_amt",
    "chronic_burden": "chronic_count",
    "coverage_stability": "bene_hi_mons",
    "has_hmo": "bene_hmo_mons",
}


def _pair_parts() -> tuple[Column, Column]:
    z = F.coalesce(F.col("is_inpatient").cast("double"), F.lit(0.0))
    a = (z == 1).cast("double")
    b = (F.coalesce(F.col("los_days").cast("double"), F.lit(1.0)) <= 0).cast("double")
    return a, b


def term_columns(df: DataFrame) -> DataFrame:
    terms = {f"t_{n}": t for n, _, t in scorecard_terms() if n in _TERM_FEATURE}
    a, b = _pair_parts()
    terms.update({"t_a": a, "t_b": b})
    return df.withColumns(terms)


def background_means(features: DataFrame) -> dict[str, float]:
    """One aggregate over the background: E[t] per term, E[a], E[b], E[ab]."""
    t = term_columns(features)
    names = [f"t_{n}" for n in _TERM_FEATURE] + ["t_a", "t_b"]
    row = t.agg(*[F.avg(c).alias(c) for c in names],
                F.avg(F.col("t_a") * F.col("t_b")).alias("t_ab")).first()
    return {k: float(row[k] if row[k] is not None else 0.0) for k in row.asDict()}


def with_scorecard_shap(features: DataFrame, intercept: float, means: dict[str, float]) -> DataFrame:
    """Adds ``base_value``, ``log_odds`` and ``phi_<feature>`` for all 36 features."""
    weights = {n: w for n, w, _ in scorecard_terms()}
    t = term_columns(features)
    phi: dict[str, Column] = {f: F.lit(0.0) for f in K.FEATURE_COLS}
    for n, feat in _TERM_FEATURE.items():
        phi[feat] = phi[feat] + F.lit(weights[n]) * (F.col(f"t_{n}") - F.lit(means[f"t_{n}"]))
    w4 = weights["zero_los_inpatient"]
    a, b = F.col("t_a"), F.col("t_b")
    ea, eb, eab = F.lit(means["t_a"]), F.lit(means["t_b"]), F.lit(means["t_ab"])
    phi["is_inpatient"] = F.lit(w4 * 0.5) * ((a * eb - eab) + (a * b - ea * b))
    phi["los_days"] = F.lit(w4 * 0.5) * ((ea * b - eab) + (a * b - a * eb))
    base = intercept + sum(weights[n] * means[f"t_{n}"] for n in _TERM_FEATURE) + w4 * means["t_ab"]
    out = t.withColumns({f"phi_{f}": phi[f] for f in K.FEATURE_COLS})
    total = sum((F.col(f"phi_{f}") for f in K.FEATURE_COLS), F.lit(base))
    drop = [c for c in out.columns if c.startswith("t_")]
    return out.withColumn("base_value", F.lit(base)).withColumn("log_odds", total).drop(*drop)


def shap_structs(prefix: str = "phi_") -> Column:
    """array<struct<key, idx, feature, value>> sorted by |value| desc, then index.

    The key rounds |value| to 1e-9 so that float noise between engines does
    not reorder equal attributions; ties fall back to the feature order.
    """
    items = [F.struct(F.round(-F.abs(F.col(f"{prefix}{f}")), 9).alias("key"), F.lit(i).alias("idx"),
                      F.lit(f).alias("feature"), F.col(f"{prefix}{f}").alias("value"))
             for i, f in enumerate(K.FEATURE_COLS)]
    return F.sort_array(F.array(*items))


def with_once(df: DataFrame, expr: Column, name: str) -> DataFrame:
    """Add ``expr`` as a column computed once per row.

    Catalyst inlines a projected expression into every later reference, so an
    array sort referenced k times would run k times. A generator output is
    not inlined: ``inline(array(struct(expr)))`` pins one evaluation.
    """
    return df.select("*", F.inline(F.array(F.struct(expr.alias(name)))))


def ranked_rows(arr: Column, k: int) -> Column:
    """``inline`` input: (rank, d) rows for the first k elements of a sorted array."""
    return F.inline(F.arrays_zip(F.sequence(F.lit(1), F.lit(k)).alias("rank"), F.slice(arr, 1, k).alias("d")))


def direction(v: Column) -> Column:
    """Zero counts as decreasing (kept from the source behaviour)."""
    return F.when(v > 0, "increases_denial").otherwise("decreases_denial")


def shap_map(prefix: str = "phi_") -> Column:
    """MAP-1: {feature: attribution} per claim."""
    return F.map_from_arrays(F.array(*[F.lit(f) for f in K.FEATURE_COLS]),
                             F.array(*[F.col(f"{prefix}{f}") for f in K.FEATURE_COLS]))


def top_drivers(shap: DataFrame, k: int = 10) -> DataFrame:
    """WIN-2: top-k drivers per claim by |attribution|, tie by feature order."""
    rows = shap.select("claim_id", ranked_rows(shap_structs(), k))
    return rows.filter(F.col("d").isNotNull()).select(
        "claim_id", "rank", F.col("d.feature").alias("feature"), F.round("d.value", 6).alias("shap_value"),
        direction(F.col("d.value")).alias("direction"))


def waterfall(shap: DataFrame, max_display: int = 15) -> DataFrame:
    """WIN-4 as a table: top (max_display - 1) features, one 'other' row, and a
    running total from the base value to the claim's log-odds (computed inside
    the claim's own array: no window over the table)."""
    keep, n = max_display - 1, len(K.FEATURE_COLS)
    s = with_once(shap.select("claim_id", "base_value", *[f"phi_{f}" for f in K.FEATURE_COLS]),
                  shap_structs(), "d").select("claim_id", "base_value", "d")
    vals = F.col("d.value")
    rest = F.aggregate(F.slice(vals, keep + 1, n - keep), F.lit(0.0), lambda a, x: a + x)
    s = with_once(s, F.concat(F.slice(vals, 1, keep), F.array(rest)), "sv")
    names = F.concat(F.slice(F.col("d.feature"), 1, keep), F.array(F.lit(f"{n - keep} other features")))
    cums = F.aggregate(F.col("sv"), F.array().cast("array<double>"), lambda acc, x: F.concat(
        acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)))
    z = F.arrays_zip(F.sequence(F.lit(1), F.lit(max_display)).alias("step"), names.alias("feature"),
                     F.col("sv").alias("value"), cums.alias("cum"))
    return s.select("claim_id", "base_value", F.inline(z)).select(
        "claim_id", "step", "feature", F.round("value", 6).alias("shap_value"),
        F.round(F.col("base_value") + F.col("cum"), 6).alias("cumulative"))


def column_profile(shap: DataFrame, stats) -> DataFrame:
    """(feature, idx, *stats) from one pass: every feature's statistics in one aggregate, whose single row is unpivoted.

    ``stats(phi, x)`` gives named Columns of a feature's attribution and value
    (null where ``shap`` has no values). The statistics merge (sums, sketches),
    so each task sends one row, and no claim becomes 36 rows.
    """
    have, aggs, groups = set(shap.columns), [], []
    for i, f in enumerate(K.FEATURE_COLS):
        x = F.col(f).cast("double") if f in have else F.lit(None).cast("double")
        named = stats(F.col(f"phi_{f}").cast("double"), x)
        aggs += [c.alias(f"{name}__{i}") for name, c in named.items()]
        groups.append(F.struct(F.lit(f).alias("feature"), F.lit(i).alias("idx"), *[F.col(f"{name}__{i}").alias(name) for name in named]))
    return shap.agg(*aggs).select(F.inline(F.array(*groups)))


def global_importance(shap: DataFrame) -> DataFrame:
    """AGG-5 + SRT-1: mean |attribution| per feature, ranked (36 rows)."""
    from pyspark.sql import Window
    agg = column_profile(shap, lambda phi, x: {"m": F.avg(F.abs(phi))}).filter("m IS NOT NULL")
    w = Window.orderBy(F.round(F.col("m"), 9).desc(), "idx")  # 36 rows only
    return agg.select("feature", F.round("m", 6).alias("mean_abs_shap"), F.row_number().over(w).alias("rank"))


#: Quantiles of a beeswarm row, and the accuracy of their sketch (an error of one row in so many).
BEESWARM_QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
QUANTILE_ACCURACY = 1_000_000


def beeswarm_summary(shap: DataFrame) -> DataFrame:
    """XAI-3 input as a table: per feature, attribution against value, with quantiles and correlation.

    The correlation is null where the attribution or the value doesn't vary.
    """
    def stats(phi: Column, x: Column) -> dict[str, Column]:
        pos = phi > 0
        quantiles = F.percentile_approx(phi, list(BEESWARM_QUANTILES.values()), QUANTILE_ACCURACY)
        corr = F.try_divide(F.covar_pop(phi, x), F.stddev_pop(F.when(x.isNotNull(), phi)) * F.stddev_pop(x))
        varies = (F.min(phi) < F.max(phi)) & (F.min(x) < F.max(x))
        return {"n": F.count(F.lit(1)), "mean_abs_shap": F.round(F.avg(F.abs(phi)), 6), "mean_shap": F.round(F.avg(phi), 6), "n_positive": F.sum(pos.cast("long")),
                "mean_value_when_positive": F.round(F.avg(F.when(pos, x)), 6), "mean_value_when_not_positive": F.round(F.avg(F.when(~pos, x)), 6),
                "quantiles": quantiles, "corr_with_value": F.when(varies, F.round(corr, 6))}

    out = column_profile(shap, stats).filter("n > 0")
    return out.select("feature", "n", "mean_abs_shap", "mean_shap", "n_positive", "mean_value_when_positive", "mean_value_when_not_positive",
                      *[F.round(F.col("quantiles")[k], 6).alias(name) for k, name in enumerate(BEESWARM_QUANTILES)], "corr_with_value")


def hint_table(spark) -> DataFrame:
    """JOIN-2 dimension: feature -> hint text (36 rows, broadcast-safe)."""
    rows = [(f, K.HINTS.get(f, K.DEFAULT_HINT), K.FEATURE_LABELS.get(f, f)) for f in K.FEATURE_COLS]
    return spark.createDataFrame(rows, "feature string, hint string, label string")


def hint_column(feature: Column) -> Column:
    """Hint text looked up from a literal map (the dimension is 36 fixed rows)."""
    m = F.create_map(*[x for f in K.FEATURE_COLS for x in (F.lit(f), F.lit(K.HINTS.get(f, K.DEFAULT_HINT)))])
    return F.coalesce(m[feature], F.lit(K.DEFAULT_HINT))


def counterfactual_hints(shap: DataFrame, prob: str = "prediction_prob", top_n: int = 3) -> DataFrame:
    """XAI-4: for p > 0.5 the top positive drivers with their hint text;
    otherwise one 'APPROVED' line. One output row per hint."""
    d = F.col("d")
    positives = F.slice(F.filter(d, lambda x: x["value"] > 0), 1, top_n)
    hints = F.transform(positives, lambda x: F.format_string(
        "[%s  SHAP=%s]  %s", x["feature"], F.format_string("%+.4f", F.round(x["value"], 4)),
        hint_column(x["feature"])))
    arr = F.when(F.col(prob) > K.DENY_THRESHOLD, hints).otherwise(F.array(F.lit(K.APPROVED_HINT)))
    s = with_once(shap.select("claim_id", prob, *[f"phi_{f}" for f in K.FEATURE_COLS]), shap_structs(), "d")
    s = with_once(s.select("claim_id", prob, "d"), arr, "hints")
    return (s.select("claim_id", F.posexplode("hints").alias("pos", "hint"))
             .select("claim_id", (F.col("pos") + 1).alias("hint_rank"), "hint"))
