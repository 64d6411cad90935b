"""Batch runner: build and write every pipeline table (SNK-1, SNK-3, SNK-4, SNK-5).

``build_all(spark, sf_dir, out)`` writes, under ``out`` (a shared folder):

* ``claims_raw`` and ``claims_features`` (parquet, partitioned by sample)
* ``meps_denial_rates``
* ``runs`` (append: one row per trained model and run)
* ``audit_log`` (append: validated override entries that it doesn't have yet)
* ``letters`` (member letter + adjuster summary per claim)
* ``shap_global`` (Tree SHAP on the 2,000-claim sample)
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import audit as AU
from . import catalog as C
from . import models as M
from . import pipeline as P


def build_all(spark: SparkSession, sf_dir: str, out: str, with_models: bool = True) -> dict[str, str]:
    out = out.rstrip("/")
    paths = {}

    def put(name, df, mode="overwrite", part=None):
        w = df.write.mode(mode)
        if part:
            w = w.partitionBy(part)
        w.parquet(f"{out}/{name}")
        paths[name] = f"{out}/{name}"

    put("claims_raw", P.claims_raw(spark, sf_dir), part="sample_num")
    put("claims_features", P.claims_features(spark, sf_dir), part="sample_num")
    put("meps_denial_rates", P.survey_rates(spark, sf_dir))
    entries = AU.entries_from_requests(C._requests(spark, sf_dir))
    AU.append_entries(entries, f"{out}/audit_log")
    paths["audit_log"] = f"{out}/audit_log"
    if with_models:
        put("runs", M.runs(spark, sf_dir).withColumn("created_at", F.current_timestamp()), mode="append")
        put("letters", C._model_letters(spark, sf_dir))
        put("shap_global", C.QUERIES["shap_global_sample"](spark, sf_dir))
    else:
        put("letters", C.QUERIES["scorecard_letters"](spark, sf_dir))
    return paths
