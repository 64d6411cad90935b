"""Table builders over a scale-factor folder of driver tables.

One lazy plan per stage: adapter -> clean -> join (``claims_raw``) and
features -> label (``claims_features``); each stage's table is written once
to the shared checkpoint folder and read back by later queries. The only
other eager steps are one-row aggregates (label intercept, background means).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEATURE_COLS, ID_COLS
from ..operators import features as feat
from ..operators import ingest, label, survey
from ..session import ensure_checkpoint_dir, settings
from ..sources import fixtures

_INTERCEPTS: dict[tuple[str, str], float] = {}


def clean_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clean_claims(fixtures.raw_claims(spark, sf_dir))


def clean_bene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clean_bene(fixtures.raw_bene(spark, sf_dir))


def claims_raw_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.claims_raw(fixtures.raw_claims(spark, sf_dir), fixtures.raw_bene(spark, sf_dir))


_TABLES: dict[tuple[str, str, str], str] = {}
ROW_GROUP_BYTES = 8 << 20
#: A stage writes up to so many samples side by side and so needn't sort its rows by sample; HotSpot only compiles methods of up to 8000 bytes, and the
#: projections of a stage, fused into one method, are far longer: above that size Spark generates a method for each part instead.
STAGE_SETTINGS = {"spark.sql.maxConcurrentOutputFileWriters": "24", "spark.sql.codegen.hugeMethodLimit": "8000"}


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write a stage's table once into the shared checkpoint folder, then read it.

    This is the pipeline's stage boundary (the raw and feature tables are
    written tables, as in the batch design): it cuts lineage, so a lost
    executor recomputes from the written files, not from the raw inputs, and
    every later query scans a columnar table with pruning and pushdown.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        root = ensure_checkpoint_dir(spark).rstrip("/")
        tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
        path = f"{root}/tables/{spark.sparkContext.applicationId}/{tag}/{name}"
        # small row groups: a reader that works hard on every row (the explainers) can be split finely by spark.sql.files.maxPartitionBytes
        with settings(spark, STAGE_SETTINGS):
            (build().write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd")
                    .partitionBy("sample_num").parquet(path))
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def claims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written ``claims_raw`` table (45 columns)."""
    df = materialized(spark, sf_dir, "claims_raw", lambda: claims_raw_plan(spark, sf_dir))
    return df.select(*ingest.CLAIMS_RAW_COLUMNS)


def survey_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.survey_rates(spark, fixtures.raw_survey(spark, sf_dir))


def intercept(spark: SparkSession, sf_dir: str) -> float:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INTERCEPTS:
        _INTERCEPTS[key] = label.intercept_of(survey_rates(spark, sf_dir))
    return _INTERCEPTS[key]


def features_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.build_features(claims_raw(spark, sf_dir))


def claims_features_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.with_denial_label(features_unlabelled(spark, sf_dir), intercept(spark, sf_dir))


FEATURE_TABLE_COLUMNS = [*ID_COLS, *FEATURE_COLS, "denial_prob", "denial_label"]


def claims_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written 42-column ``claims_features`` table (ids, 36 features, prob, label)."""
    df = materialized(spark, sf_dir, "claims_features", lambda: claims_features_plan(spark, sf_dir))
    return df.select(*FEATURE_TABLE_COLUMNS)


_MEANS: dict[tuple[str, str], dict] = {}


def background_means(spark: SparkSession, sf_dir: str) -> dict:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MEANS:
        from ..operators.shap import background_means as bm
        _MEANS[key] = bm(claims_features(spark, sf_dir))
    return _MEANS[key]


def scorecard_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims features + scorecard attributions (``phi_*``, ``base_value``)."""
    from ..operators.shap import with_scorecard_shap
    f = claims_features(spark, sf_dir)
    return with_scorecard_shap(f, intercept(spark, sf_dir), background_means(spark, sf_dir)) \
        .withColumn("prediction_prob", F.col("denial_prob"))
