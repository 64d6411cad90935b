"""The audit log holds every request once, whatever is run or delivered again."""

from pyspark.sql import functions as F

from claimspark.operators import audit as AU

SCHEMA = "claim_id string, member_id string, adjuster_name string, original_prob double, recommended_action string, override_decision string, reason string, requested_at timestamp"


def requests(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("requested_at timestamp", "requested_at string")).withColumn("requested_at", F.col("requested_at").cast("timestamp"))


def row(k, day="2008-01-01", **other):
    base = {"claim_id": f"c{k}", "member_id": "m", "adjuster_name": "a", "original_prob": 0.25, "recommended_action": "DENY", "override_decision": "APPROVE",
            "reason": "seen the paper log", "requested_at": f"{day} 10:00:00"} | other
    return tuple(base.values())


def ids(spark, rows):
    return [r.audit_id for r in AU.entries_from_requests(requests(spark, rows)).collect()]


def test_every_field_is_in_the_id(spark):
    variants = [row(1), row(1, member_id=None), row(1, member_id=""), row(1, adjuster_name="b"), row(1, original_prob=0.250001), row(1, recommended_action="APPROVE"),
                row(1, override_decision="DENY"), row(1, reason="seen the paper log!"), row(1, day="2008-01-02"), row(1, requested_at=None), row(2)]
    found = ids(spark, variants)
    assert len(set(found)) == len(variants) and all(len(i) == 32 for i in found)
    assert ids(spark, [row(1), row(1)]) == ids(spark, [row(1)])
    # the border between fields counts
    assert len(set(ids(spark, [row("x|1:y", member_id="z"), row("x", member_id="y|1:z")]))) == 2


def test_rerun_redelivery_and_lost_ledger(spark, tmp_path):
    log = str(tmp_path / "log")
    first = AU.entries_from_requests(requests(spark, [row(k, f"2008-01-{1 + k % 3:02}") for k in range(9)]))
    assert AU.append_entries(first, log, "b1") == 9
    assert AU.append_entries(first, log, "b1") == 0  # named in the ledger
    assert AU.append_entries(first, log) == 0  # found in the log
    more = AU.entries_from_requests(requests(spark, [row(k, f"2008-01-{1 + k % 3:02}") for k in range(5, 12)] + [row(1, "2009-01-01"), row(1, requested_at=None)]))
    assert AU.append_entries(more, log, "b2") == 5
    got = AU.read_log(spark, log)
    assert got.count() == got.select("audit_id").distinct().count() == 14
    assert {r.day for r in got.select("day").distinct().collect()} == {"2008-01-01", "2008-01-02", "2008-01-03", "2009-01-01", "unknown"}
    assert [(r.batch_id, r.n_new) for r in spark.read.parquet(f"{log}_ledger").orderBy("batch_id").collect()] == [("b1", 9), ("b2", 5)]


def test_only_touched_days_are_looked_up(spark, tmp_path):
    log = str(tmp_path / "log")
    for day in ("2008-01-01", "2008-01-02"):
        AU.append_entries(AU.entries_from_requests(requests(spark, [row(1, day)])), log)
    known = AU.read_log(spark, log).filter(F.col("day").isin(["2008-01-02"]))
    assert len(known.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(day" in known._jdf.queryExecution().toString() or known.count() == 1


def test_empty_batch_and_empty_log(spark, tmp_path):
    log = str(tmp_path / "none")
    assert AU.read_log(spark, log).count() == 0
    assert AU.append_entries(AU.entries_from_requests(requests(spark, [row(1, reason="no")])), log) == 0


def test_pages_by_key_cover_the_log(spark):
    rows = [(f"a{k:02}", f"t{k // 4}") for k in range(23)]
    log = spark.createDataFrame(rows, "audit_id string, timestamp string")
    seen, after = [], None
    while page := AU.page_after(log, after, 5).collect():
        seen += [(r.audit_id, r.timestamp) for r in page]
        after = (page[-1].timestamp, page[-1].audit_id)
    assert seen == sorted(rows, key=lambda r: (r[1], r[0]))
