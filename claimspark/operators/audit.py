"""Override audit log (AUD-1, AUD-2, WIN-6, SNK-4, STR-10).

The log is an append-only table that holds every id once. Entries come from
validated override requests; pages are ordered by (timestamp, audit_id) so a page is the same
however the table is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..sources.files import optional_table
from .quality import with_override_violations

AUDIT_COLUMNS = ["audit_id", "claim_id", "member_id", "adjuster_name", "model_decision", "model_prob",
                 "final_decision", "override_reason", "timestamp"]


REQUEST_FIELDS = ["claim_id", "member_id", "adjuster_name", "original_prob", "recommended_action", "override_decision", "reason", "requested_at"]


def audit_id_column(fields: dict | None = None) -> Column:
    """AUD-1: 128-bit id of a request's whole content, so a request delivered again keeps its id and no two others share one.

    Every field counts, with its length, and a null is not an empty text.
    Probabilities count to six places, times to microseconds.
    """
    text = {c: F.col(c).cast("string") for c in REQUEST_FIELDS} | {
        "original_prob": F.col("original_prob").cast("decimal(18,6)").cast("string"),
        "requested_at": F.date_format(F.col("requested_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")} | (fields or {})
    return F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text.values()]))


def entries_from_requests(requests: DataFrame, now=None) -> DataFrame:
    """Valid override requests -> audit entries, one of each request (``day``: that of the request, for the log's partitions).

    ``requests`` has the ``REQUEST_FIELDS``; a request without ``requested_at`` may lack the column.
    """
    if "requested_at" not in requests.columns:
        requests = requests.withColumn("requested_at", F.lit(None).cast("timestamp"))
    checked = with_override_violations(requests, "override_decision", "reason").filter("is_valid")
    ts = now if now is not None else F.current_timestamp()
    return first_of_each(checked.select(
        audit_id_column().alias("audit_id"),
        "claim_id", F.coalesce("member_id", F.lit("")).alias("member_id"),
        F.coalesce("adjuster_name", F.lit("")).alias("adjuster_name"),
        F.col("recommended_action").alias("model_decision"),
        F.round("original_prob", 4).alias("model_prob"),
        F.col("override_decision").alias("final_decision"),
        F.col("reason").alias("override_reason"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.coalesce(F.date_format(F.col("requested_at").cast("timestamp"), "yyyy-MM-dd"), F.lit("unknown")).alias("day")))


def first_of_each(entries: DataFrame) -> DataFrame:
    """One entry of each ``audit_id``: the earliest, then the first by its other columns."""
    rest = [c for c in entries.columns if c not in ("audit_id", "timestamp")]
    first = F.min(F.struct("timestamp", *rest)).alias("first")
    return entries.groupBy("audit_id").agg(first).select("audit_id", "first.*").select(*entries.columns)


LOG_SCHEMA = ("audit_id string, claim_id string, member_id string, adjuster_name string, model_decision string, model_prob double, "
              "final_decision string, override_reason string, timestamp string, day string")
LEDGER_SCHEMA = "batch_id string, n_new long, committed_at timestamp"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The audit table; empty if nothing was ever appended. Reading needs no merge: ids are unique as written."""
    return optional_table(spark, path, LOG_SCHEMA)


def append_entries(entries: DataFrame, path: str, batch_id: str | None = None) -> int:
    """SNK-4: append the entries whose ids the log doesn't have; returns how many.

    The log is partitioned by ``day`` (that of the request, or else of the
    entry's timestamp). An id belongs to one day, so only the days that the
    batch touches are looked up. A batch that the ledger (``<path>_ledger``)
    names is not looked at again. A run that ended between the append and the
    ledger is harmless: its entries are found in the log. One writer at a time.
    """
    spark = entries.sparkSession
    ledger = f"{path}_ledger"
    if batch_id is not None and not optional_table(spark, ledger, LEDGER_SCHEMA).filter(F.col("batch_id") == batch_id).isEmpty():
        return 0
    if "day" not in entries.columns:
        entries = entries.withColumn("day", F.coalesce(F.substring("timestamp", 1, 10), F.lit("unknown")))
    batch = first_of_each(entries.select(*AUDIT_COLUMNS, "day")).persist()
    days = [r.day for r in batch.select("day").distinct().collect()]  # a row per day of the batch
    known = read_log(spark, path).filter(F.col("day").isin(days)).select("audit_id", "day")
    seen = Observation()
    new = batch.join(known, ["audit_id", "day"], "left_anti").observe(seen, F.count(F.lit(1)).alias("n"))
    new.write.mode("append").partitionBy("day").parquet(path)
    batch.unpersist()
    n = int(seen.get.get("n") or 0)
    if batch_id is not None:
        spark.createDataFrame([(batch_id, n)], "batch_id string, n_new long").withColumn("committed_at", F.current_timestamp()) \
             .write.mode("append").parquet(ledger)
    return n


def with_is_override(df: DataFrame) -> DataFrame:
    """An 'override' may agree with the model; flag the ones that differ."""
    return df.withColumn("is_override", F.col("final_decision") != F.col("model_decision"))


def reason_short(col: str = "override_reason", width: int = K.AUDIT_REASON_DISPLAY_LEN):
    """STR-10: first 35 characters + '...' when longer."""
    c = F.col(col)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def page(log: DataFrame, page_no: int = 1, page_size: int = 20) -> DataFrame:
    """WIN-6: one page in insertion order, plus the total.

    ``orderBy(..).offset(..).limit(..)`` plans as a per-partition top-k of
    page_no * page_size rows (bounded by the request), not a full sort.
    """
    if page_no < 1 or not (1 <= page_size <= 100):
        raise ValueError("page >= 1 and 1 <= page_size <= 100")
    total = log.count()
    return (log.orderBy("timestamp", "audit_id").offset((page_no - 1) * page_size).limit(page_size)
               .withColumns({"total": F.lit(total), "page": F.lit(page_no), "page_size": F.lit(page_size)}))


def page_after(log: DataFrame, after: tuple[str, str] | None = None, page_size: int = 20) -> DataFrame:
    """WIN-6 by key: the entries that follow ``after`` = (timestamp, audit_id) of the last one seen.

    Each task keeps ``page_size`` rows at most, so a deep page costs what the
    first one costs; on the written log the time filter skips row groups.
    """
    if not 1 <= page_size <= 100:
        raise ValueError("1 <= page_size <= 100")
    if after is not None:
        ts, audit_id = (F.lit(x) for x in after)
        log = log.filter((F.col("timestamp") > ts) | ((F.col("timestamp") == ts) & (F.col("audit_id") > audit_id)))
    return log.orderBy("timestamp", "audit_id").limit(page_size)


def report(log: DataFrame) -> DataFrame:
    """AUD-2: ordered display columns with the truncated reason."""
    return with_is_override(log).select("audit_id", "claim_id", "adjuster_name", "model_decision",
                                        "final_decision", reason_short().alias("reason_short"), "is_override")
