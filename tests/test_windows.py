import datetime as dt

from pyspark.sql import functions as F

from surgelens.operators import grid, sweep, velocity as V
from surgelens.operators.window_features import additive_features, window_features
from surgelens.plans.catalog import CATALOG
from surgelens.sources import fixtures as fx, intake


def test_half_open_membership(spark):
    df = spark.sql("select 'm' merchant_id, timestamp'2024-01-01 00:05:00' timestamp")
    ends = sorted(r.window_end.minute for r in grid.assign_windows(df, ("5m",)).collect())
    assert ends == [6, 7, 8, 9, 10]
    inside = grid.contains(F.to_timestamp(F.lit("2024-01-01 00:05:00")), F.lit("5m"), F.col("timestamp"))
    assert df.select(inside.alias("x")).first().x is False


def test_tiles_add_up(spark, tiny):
    """A window's count is the sum over the 1-minute windows that tile it."""
    w = additive_features(fx.annotated(spark, tiny)).select("merchant_id", "window_size", "window_end", "B_txn_count")
    one = w.filter("window_size = '1m'").select("merchant_id", F.col("window_end").alias("tile_end"), F.col("B_txn_count").alias("n"))
    tiled = grid.tiles(w).join(one, ["merchant_id", "tile_end"], "left").groupBy("merchant_id", "window_size", "window_end").agg(
        F.first("B_txn_count").alias("whole"), F.sum("n").alias("parts"))
    assert tiled.filter("whole <> parts").count() == 0


def test_features_match_sql(spark, tiny, con):
    from tests.check_oracle import compare
    run, sql = CATALOG["window_features"]
    assert compare(run(spark, tiny).toPandas(), con.execute(sql).df()).startswith("ok")


def test_empty_windows_are_finite(spark, tiny):
    a = fx.annotated(spark, tiny)
    rows = window_features(a, ("5m",), spine=grid.window_spine(a, ("5m",)))
    empty = rows.filter("B_txn_count = 0").limit(5).collect()
    assert empty and all(r.A_interarrival_mean == 300.0 and r.J_accounts_per_ip_max == 1.0 and r.G_account_age_median == 0.0 for r in empty)


def test_first_delivery_wins(spark, tiny):
    good, bad = intake.validate_events(fx.envelopes(spark, tiny))
    once = intake.dedupe(good)
    assert once.filter("status = 'duplicate'").count() > 0
    again = intake.dedupe(good, once.filter("status = 'accepted'"))
    assert again.filter("status = 'accepted'").count() == 0
    assert {"schema_version", "card_number", "amount", "attempt_number"} <= {x for r in bad.select("reasons").collect() for x in r.reasons}


def test_velocity_matches_sql(spark, tiny, con):
    from tests.check_oracle import compare
    for name in ("velocity_flags", "trailing_distinct_members", "window_metrics", "single_feature_auc"):
        run, sql = CATALOG[name]
        assert compare(run(spark, tiny).toPandas(), con.execute(sql).df()).startswith("ok"), name


def test_redelivered_events_come_from_their_own_rows(spark, tiny):
    """The union of event kinds is neither kept nor read a second time for the redelivered ones."""
    from pyspark.sql import functions as F
    events = fx.envelopes(spark, tiny)
    assert "InMemoryRelation" not in events._jdf.queryExecution().executedPlan().toString()
    again = events.groupBy("event_id").agg(F.count("*").alias("n"), (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))).alias("us")).collect()
    assert all((r.n, r.us) == ((2, 1_000_000) if int(r.event_id[3:]) % 50 == 0 else (1, 0)) for r in again) and len(again) > 400


def test_rows_as_joined_keep_repeats_and_missing_keys(spark):
    from surgelens.operators.lifecycle import as_joined
    left = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4), ("c", 5)], "k string, v int")
    for right in ([("a",), ("b",), ("b",), ("b",), (None,), (None,), ("z",), ("z",)], [("a",), ("b",)], []):
        other = spark.createDataFrame(right, "k string")
        got = sorted(as_joined(left, other, "k").select("v").collect())
        assert got == sorted(left.join(other, "k", "left").select("v").collect())


def test_scored_and_graph_inputs_move_no_attempts_for_places(spark, tiny):
    """Places are read by neither, so attempts are not shuffled by user for them, nor by transaction for the graph."""
    from surgelens.sources import fixtures as fx
    entities, whole = fx.entity_attempts(spark, tiny), fx.annotated(spark, tiny)
    cols = [c for c in entities.columns if c != "geo"]
    assert sorted(map(str, entities.select(*cols).collect())) == sorted(map(str, whole.select(*cols).collect()))
    for df in (entities, fx.attempts(spark, tiny, geo=False)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_read_the_attempts_once(spark, tiny):
    from surgelens.operators import labels as L
    from surgelens.sources import fixtures as fx
    plan = L.lift_labels(fx.labelled(spark, tiny, geo=False))._jdf.queryExecution().logical().toString()
    cached = L.lift_labels(fx.labelled(spark, tiny, geo=False))._jdf.queryExecution().withCachedData().toString()
    assert "Relation [event_id" in plan and "Relation [event_id" not in cached and "InMemoryRelation" in cached
