"""Structured Streaming jobs (ST-1 score arriving claims, ST-2 override audit).

ST-1 is stateless: each micro-batch of raw claim rows goes through the same
cleaning, stream-static beneficiary join, feature and scoring expressions as
the batch plan, so stream output equals batch output.
ST-2 validates override requests and merges every micro-batch by ``audit_id``
into the audit log, without state, so that no request is too late, whatever the
order of the files, and reading the log needs no merge.

Both run with ``trigger(availableNow=True)``; their checkpoints live under the cluster's shared checkpoint folder, so a restart
resumes exactly where the last committed batch ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..operators import features as FE
from ..operators import ingest
from ..operators.audit import AUDIT_COLUMNS, append_entries
from ..operators.label import with_scorecard
from ..operators.metrics import decisions
from ..operators.quality import with_override_violations


def claims_stream(spark: SparkSession, source_dir: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source_dir)


def score_claims(raw_claims: DataFrame, bene: DataFrame, intercept: float, sample_num: int = 1) -> DataFrame:
    """ST-1 transform (works on a stream or a batch frame)."""
    joined = ingest.join_beneficiaries(ingest.clean_claims(raw_claims), bene, sample_num)
    feats = FE.build_features(joined.select(*ingest.CLAIMS_RAW_COLUMNS))
    scored = with_scorecard(feats, intercept).select("claim_id", F.col("denial_prob").alias("prediction_prob"))
    return decisions(scored)


def audit_entries(overrides: DataFrame) -> DataFrame:
    """ST-2 transform: valid audit entries, as often as they are delivered (``run_audit`` merges them)."""
    checked = with_override_violations(overrides).filter("is_valid")
    return (checked.withColumn("timestamp", F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
                   .select(*AUDIT_COLUMNS))


def run_audit(entries: DataFrame, log: str, checkpoint: str) -> None:
    """ST-2 sink: merge every micro-batch into the audit log as it is written.

    A batch is appended under the id of its stream and number, so one that is
    run again after a failure, like a request delivered again, adds nothing.
    """
    def merge(batch: DataFrame, number: int) -> None:
        append_entries(batch, log, f"{checkpoint}#{number}")

    q = (entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def run_available(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything available now, then stop (exactly-once file sink)."""
    q = (df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


__all__ = ["claims_stream", "score_claims", "audit_entries", "run_audit", "run_available", "K"]
