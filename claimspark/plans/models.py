"""Model-side tables over a scale-factor folder: train once, reuse per session.

Models are saved under the cluster's shared checkpoint folder (never a
machine-local temp folder), and the Tree SHAP / LIME operators read the
saved node table back from there.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import explain as EX
from ..operators import lime as LM
from ..operators import model as MD
from ..operators import treeshap as TS
from ..operators.sampling import uniform_sample
from ..session import ensure_checkpoint_dir
from . import pipeline as P

_CACHE: dict[tuple, object] = {}


def _key(spark, sf_dir, what):
    return (spark.sparkContext.applicationId, sf_dir, what)


def model_dir(spark: SparkSession, sf_dir: str, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
    return f"{root}/models/{spark.sparkContext.applicationId}/{tag}/{name}"


def train_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MD.training_frame(P.claims_features(spark, sf_dir))


def trained(spark: SparkSession, sf_dir: str, name: str) -> MD.Trained:
    k = _key(spark, sf_dir, name)
    if k not in _CACHE:
        fit = MD.fit_champion if name == "champion" else MD.fit_challenger
        t = fit(train_frame(spark, sf_dir), model_dir(spark, sf_dir, f"{name}-rounds"))
        MD.save(t, model_dir(spark, sf_dir, name))
        _CACHE[k] = t
    return _CACHE[k]


def tree_arrays(spark: SparkSession, sf_dir: str) -> MD.TreeArrays:
    k = _key(spark, sf_dir, "arrays")
    if k not in _CACHE:
        trained(spark, sf_dir, "champion")
        _CACHE[k] = MD.tree_arrays(spark, model_dir(spark, sf_dir, "champion"),
                                   trained(spark, sf_dir, "champion").model)
    return _CACHE[k]


def gbt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MD.score(trained(spark, sf_dir, "champion").model, P.claims_features(spark, sf_dir))


def metrics(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return MD.evaluate(trained(spark, sf_dir, name).model, train_frame(spark, sf_dir)) \
        .withColumn("model", F.lit(name))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("champion", "challenger"):
        t = trained(spark, sf_dir, name)
        r = MD.run_record(spark, t, metrics(spark, sf_dir, name).drop("model"), model_dir(spark, sf_dir, name))
        out = r if out is None else out.unionByName(r)
    return out


def tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TS.tree_shap(P.claims_features(spark, sf_dir), tree_arrays(spark, sf_dir))


def lime_profile(spark: SparkSession, sf_dir: str) -> dict:
    k = _key(spark, sf_dir, "lime_profile")
    if k not in _CACHE:
        bg = uniform_sample(P.claims_features(spark, sf_dir), K.LIME_BACKGROUND_SIZE, seed="background-42")
        _CACHE[k] = LM.background_profile(bg)
    return _CACHE[k]


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree SHAP and LIME of every claim, approved or not, in its row."""
    return EX.explain(P.claims_features(spark, sf_dir), tree_arrays(spark, sf_dir), lime_profile(spark, sf_dir))


def lime_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EX.reason_rows(explained(spark, sf_dir))
