from pyspark.sql import functions as F

from surgelens import schemas as S
from surgelens.sources import fixtures as fx, intake, stores
from surgelens.streaming import jobs


def test_stream_intake_claims_once(spark, tiny, tmp_path):
    src = str(tmp_path / "in")
    fx.envelopes(spark, tiny).filter("event_type = 'PAYMENT_ATTEMPT'").write.json(src)
    stream = jobs.stream_intake(spark.readStream.schema(S.EVENT_ENVELOPE).json(src))
    jobs.start_table(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    good, _ = intake.validate_events(intake.read_events(spark, src))
    assert out.count() == good.select("idempotency_key").distinct().count()


def test_stream_windows_match_batch(spark, tiny, tmp_path):
    src = str(tmp_path / "in")
    a = fx.attempts(spark, tiny)
    a.coalesce(1).write.parquet(src)
    stream = jobs.sliding_counts(spark.readStream.schema(a.schema).parquet(src), "5m")
    jobs.start_batches(stream, jobs.write_batch(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    from surgelens.operators.window_features import additive_features
    want = additive_features(a, ("5m",)).select("merchant_id", "window_end", F.col("B_txn_count").cast("long").alias("n"))
    closed = got.select("merchant_id", "window_end", "n")
    assert closed.count() > 100 and closed.join(want, ["merchant_id", "window_end", "n"], "left_anti").count() == 0


def test_upsert_keeps_first_flag(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, first int, s string")
    new = spark.createDataFrame([("a", 9, "z"), ("c", 3, "w")], "id string, first int, s string")
    got = {r.id: (r.first, r.s) for r in stores.upsert(old, new, ["id"], ["s"]).collect()}
    assert got == {"a": (1, "z"), "b": (2, "y"), "c": (3, "w")}


def test_co_occurrence_counts_twice(spark, tiny):
    a = fx.attempts(spark, tiny).filter("customer_id is not null and device_fp is not null").limit(1)
    both = stores.co_occurrence(a.unionByName(a)).filter("entity_type_b = 'device'").first()
    assert both.co_occurrence_count == 2
