import datetime as dt

import pytest
from pyspark.sql import functions as F

from surgelens.operators import velocity
from surgelens.operators.grid import minute
from surgelens.plans import scoring
from surgelens.sources import fixtures as fx, intake, tables
from surgelens.streaming import members, scoring as closed

DAY = lambda n: dt.date(2024, 1, n)


def test_merge_touches_only_its_partitions_and_repeats_are_no_ops(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k string, day date, v long, first long")
    t = tables.KeyedTable(spark, str(tmp_path / "t"), ["k", "day"], "part", F.col("day"), ["v"])
    assert not t.exists()
    t.merge(make([("a", DAY(1), 1, 1), ("b", DAY(1), 2, 2), ("a", DAY(2), 3, 3)]))
    untouched = {p.name for p in (tmp_path / "t" / "part=2024-01-01").glob("*.parquet")}
    update = make([("a", DAY(2), 30, 30), ("c", DAY(3), 4, 4)])
    for _ in range(3):
        t.merge(update)
    assert {p.name for p in (tmp_path / "t" / "part=2024-01-01").glob("*.parquet")} == untouched
    t.merge(update.where("false"))
    t.merge(make([("c", DAY(3), 5, 9), ("c", DAY(3), 7, 8), ("d", DAY(3), 1, 1)]), order="v")
    got = {(r.k, r.day): (r.v, r.first) for r in t.read().collect()}
    assert got == {("a", DAY(1)): (1, 1), ("b", DAY(1)): (2, 2), ("a", DAY(2)): (30, 3), ("c", DAY(3)): (7, 4), ("d", DAY(3)): (1, 1)}


def test_incident_store_keeps_the_first_flag_time(spark, tmp_path):
    cols = "incident_id string, merchant_id string, severity string, status string, first_flag_time timestamp, last_flag_time timestamp, risk_score double"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = spark.createDataFrame([(f"inc_{i}", f"m_{i % 2}", "medium", "OPEN", at(i), at(i), 0.7) for i in range(6)], cols)
    store = tables.IncidentStore(spark, str(tmp_path / "i"), rows.columns)
    store.merge(rows)
    store.merge(spark.createDataFrame([("inc_3", "m_1", "high", "CONFIRMED", at(9), at(9), 0.9)], cols))
    got = store.get("inc_3").first()
    assert (got.first_flag_time, got.last_flag_time, got.status, got.risk_score) == (at(3), at(9), "CONFIRMED", 0.9)
    assert [r.incident_id for r in store.list("m_1").collect()] == ["inc_3", "inc_5", "inc_1"]
    assert [r.incident_id for r in store.list(status="OPEN", limit=2).collect()] == ["inc_5", "inc_4"]


def test_eval_store_lists_a_run_in_time_order(spark, tmp_path):
    rows = spark.createDataFrame([(s, f"m_{i % 2}", "5m", dt.datetime(2024, 1, 1, 0, 59 - i), "fusion", i / 10) for i in range(6) for s in (["test", "train"][i % 2],)],
                                 "split string, merchant_id string, window_size string, window_end timestamp, detector_name string, predicted_score double")
    store = tables.EvalStore(spark, str(tmp_path / "e"))
    store.save("r1", rows)
    store.save("r2", rows.withColumn("predicted_score", F.lit(0.5)))
    store.save("r2", rows.withColumn("predicted_score", F.lit(0.6)))
    assert store.read().count() == 12
    got = store.list("r2", "test").collect()
    assert [r.window_end.minute for r in got] == [55, 57, 59] and {r.predicted_score for r in got} == {0.6}


def test_baseline_store_versions(spark, tmp_path):
    row = lambda m, v: spark.createDataFrame([("m_1", "A.txn_rate", "5m", 3, m, 1.0, 9)], "merchant_id string, feature_id string, window_size string, hour_of_week int, expected_median double, variability_mad double, sample_count long")
    store = tables.BaselineStore(spark, str(tmp_path / "b"))
    for median, version in ((1.0, 1), (2.0, 2), (3.0, 1)):
        store.save(row(median, version), version)
    assert store.get("m_1", "A.txn_rate", "5m", 3).first().expected_median == 3.0
    assert [r.expected_median for r in store.list("m_1", 2).collect()] == [2.0] and store.list("m_9").count() == 0


def test_range_scan_reads_only_the_asked_dates(spark, tiny, tmp_path):
    raw = intake.to_raw_rows(intake.dedupe(intake.validate_events(fx.envelopes(spark, tiny))[0]).filter("status = 'accepted'")).cache()
    path = str(tmp_path / "log")
    intake.append_raw(raw.filter("event_date < '2024-01-20'"), path)
    intake.append_raw(raw.filter("event_date >= '2024-01-20'"), path)
    scan = intake.scan_events(intake.read_raw(spark, path), "m_3", "2024-01-05 00:00:00", "2024-01-07 00:00:00")
    want = intake.scan_events(raw, "m_3", "2024-01-05 00:00:00", "2024-01-07 00:00:00").select("event_id").collect()
    assert [r.event_id for r in scan.collect()] == [r.event_id for r in want] and want
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    nodes, read = [scan._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if "Scan" in node.nodeName() and node.metrics().contains("numPartitions"):
            read.append(node.metrics().apply("numPartitions").value())
        for child in ([node.executedPlan()] if hasattr(node, "executedPlan") and "Adaptive" in node.nodeName() else []) + [node.children().apply(i) for i in range(node.children().size())]:
            nodes.append(child)
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
    assert read == [3]  # of some 30 dates
    raw.unpersist()


def test_exported_csv(spark, tiny, tmp_path):
    from surgelens.sources import stores
    members = fx.annotated(spark, tiny).filter("merchant_id = 'm_4'").join(fx.truth(spark, tiny).select("transaction_id", "is_abusive"), "transaction_id")
    stores.evidence_csv(members, str(tmp_path / "csv"), 7)
    lines = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    want = members.orderBy("timestamp", "transaction_id").limit(7).collect()
    assert lines[0] == "timestamp,transaction_id,customer_id,device_fp,amount,status,is_abusive" and len(lines) == 8
    for line, r in zip(lines[1:], want):
        _, txn, customer, device, amount, status, abusive = line.split(",")
        assert (txn, customer.strip('"'), device.strip('"'), amount, abusive) == (r.transaction_id, r.customer_id or "", r.device_fp or "", str(r.amount), str(r.is_abusive).lower())
        assert status == ("CAPTURED" if r.outcome_status == "CAPTURED" else "FAILED")


# streams

@pytest.fixture(scope="module")
def two_hours(spark, tiny):
    rows = fx.annotated(spark, tiny)
    first = rows.agg(F.min(minute("timestamp"))).first()[0]
    return rows.filter(minute("timestamp") < first + 100).cache()


def _score(events):
    wide = scoring.all_features(events, ("1m", "5m"))
    return scoring.score_windows(scoring.with_twins(wide)).select("merchant_id", "window_size", "window_end", "risk_score", "D_amount_median", "J_largest_cluster_size", "B_txn_count")


def test_closed_windows_equal_batch_after_late_and_repeated_deliveries(spark, two_hours, tmp_path):
    rows = two_hours.toPandas().sample(frac=1, random_state=3)
    at = rows["timestamp"].rank(pct=True)
    late = rows.sample(frac=0.1, random_state=4).index  # far later than the lateness allows
    src = tmp_path / "in"
    for k in range(3):
        part = rows[((at > k / 3) & (at <= (k + 1) / 3) & ~rows.index.isin(late)) | ((k == 2) & rows.index.isin(late))]
        if k == 1:
            part = rows[rows.index.isin(part.index) | (at <= 0.2) & ~rows.index.isin(late)]  # the first deliveries again
        spark.createDataFrame(part, two_hours.schema).coalesce(1).write.mode("append").parquet(str(src))
    handler = closed.ClosedWindows(spark, str(tmp_path / "state"), _score, 120, ("1m", "5m"))
    stream = spark.readStream.schema(two_hours.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    closed.start(stream, handler, str(tmp_path / "ck")).awaitTermination(600)
    edge = two_hours.agg(F.max(F.unix_micros("timestamp"))).first()[0] - 120_000_000
    want = _score(two_hours).filter(F.unix_micros("window_end") <= edge // 60_000_000 * 60_000_000)
    key = lambda df: sorted((r.merchant_id, r.window_size, r.window_end, round(r.risk_score, 9), r.D_amount_median, r.J_largest_cluster_size, r.B_txn_count) for r in df.collect())
    got, wanted = key(handler.scores()), key(want)
    assert len(wanted) > 150 and got == wanted
    # a batch handed over again changes nothing
    again = spark.read.schema(two_hours.schema).parquet(str(tmp_path / "state" / "log" / "batch=1")).toPandas()
    handler(spark.createDataFrame(again, two_hours.schema), 1)
    assert key(handler.scores()) == wanted


def test_members_in_a_stream_equal_trailing_distinct(spark, two_hours, tmp_path):
    rows = two_hours.select("transaction_id", "merchant_id", "device_fp", "timestamp").orderBy("timestamp").toPandas()
    src = tmp_path / "in"
    for k in range(3):  # deliveries shuffled within, some minutes out of order between them
        part = rows[(rows.index % 50 < 45) & (rows.index * 3 // len(rows) == k) | (rows.index % 50 >= 45) & ((rows.index + 5) * 3 // len(rows) == k)]
        spark.createDataFrame(part.sample(frac=1, random_state=k), "transaction_id string, merchant_id string, device_fp string, timestamp timestamp").coalesce(1).write.mode("append").parquet(str(src))
    last = rows["timestamp"].max().to_pydatetime() + dt.timedelta(hours=3)
    end = spark.createDataFrame([("end", m, None, last) for m in sorted(rows["merchant_id"].unique())], "transaction_id string, merchant_id string, device_fp string, timestamp timestamp")
    end.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    counted = members.trailing_members(stream, "merchant_id", "device_fp", 300, "transaction_id", lateness="90 minutes")
    q = counted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {r.transaction_id: r.members for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.transaction_id: r.members for r in velocity.trailing_distinct(two_hours, "merchant_id", "device_fp", 300).collect()}
    assert len(want) > 60 and {k: v for k, v in got.items() if k != "end"} == want
