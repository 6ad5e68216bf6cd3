"""Window contents from hour tiles equal those by deltas, and bounded tiles take no deltas of items, edges or values."""

import pytest
from pyspark.sql import functions as F

from surgelens.operators import tiles, window_features as WF

CATEGORIES = ("country", "state", "method", "issuer", "bin", "decline")


def _attempts(spark):
    """1,200 attempts of two merchants over six hours, some alike, with missing entities, categories and amounts, refunds of amount zero and below."""
    i = F.col("id")
    text = lambda p, x, every: F.when(i % every != 0, F.concat(F.lit(p), x.cast("string")))
    us = F.when(i % 400 < 300, (i % 400) * 9_000_000 + 1_000_000 * (i % 3)).otherwise((i % 400) * 53_000_000) + F.lit(1_704_067_200_000_000)
    return (spark.range(1_200).withColumn("id", F.when(i % 10 == 0, i - i % 50).otherwise(i)).select(
        F.when(i % 2 == 0, "m").otherwise("n").alias("merchant_id"), F.floor(us / 60_000_000).alias("m"), us.alias("us"),
        text("c", i % 23, 19).alias("cus"), text("d", i % 31, 17).alias("dev"), text("n", i % 41, 7).alias("ins"), text("p", i % 5, 11).alias("ip"),
        F.when(i % 13 != 0, F.when(i % 29 == 0, i % 3 - 2).otherwise(F.pow(F.lit(1.3), i % 40) * 3)).cast("decimal(14,2)").alias("amount"),
        F.when(i % 6 != 0, F.element_at(F.array(*map(F.lit, ("IN", "US", "DE"))), (i % 3 + 1).cast("int"))).alias("country"),
        *[text(c, i % (2 + k), 5 + k).alias(c) for k, c in enumerate(CATEGORIES[1:])], F.lit("FAILED").alias("status"), F.lit("ISSUER").alias("decline_source"),
        F.lit(False).alias("refunded"), F.lit(False).alias("coupon"), F.lit(False).alias("cod"), F.lit(False).alias("retry"), F.lit("c").alias("city")))


def _rows(df):
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return {(r.merchant_id, r.window_size, r.end_minute): {k: value(0 if v is None else v) for k, v in r.asDict().items()} for r in df.collect()}


@pytest.fixture(scope="module")
def flat(spark):
    return _attempts(spark).cache()


def test_tiles_hold_what_deltas_give(spark, flat, monkeypatch):
    columns = ["merchant_id", "window_size", "end_minute", *[c.split(" ")[0] for c in tiles.CONTENTS.split(", ")]]
    sizes = ("1m", "5m", "1h")
    by_deltas = _rows(WF.spread_contents(flat, sizes).select(*columns))
    some = _rows(WF.window_contents(flat, WF.attempt_packs(flat), sizes, 220).select(*columns))  # larger hours are spread
    for name in ("item_steps", "neighbour_steps", "value_panes", "gap_panes"):
        monkeypatch.setattr(WF, name, lambda *a: pytest.fail("a bounded tile was spread"))
    dealt = _rows(WF.window_contents(flat, WF.attempt_packs(flat), sizes).select(*columns))
    assert len(dealt) > 900 and dealt == by_deltas
    assert some == by_deltas


def test_attempts_without_instant_or_merchant(spark, flat):
    """Merchants with undated attempts give what deltas give; without a merchant, values have no order."""
    us = [f"x.{c}" if c not in ("m", "us") else f"if(x.merchant_id = 'm' and x.us % 7 = 0, null, x.{c}) as {c}" for c in flat.columns if c != "merchant_id"]
    odd = flat.alias("x").selectExpr("if(x.merchant_id = 'n' and x.us % 2000000 = 0, null, x.merchant_id) as merchant_id", *us)
    columns = ["merchant_id", "window_size", "end_minute", *[c.split(" ")[0] for c in tiles.CONTENTS.split(", ")]]
    got, want = (_rows(df.select(*columns)) for df in (WF.window_contents(odd, WF.attempt_packs(odd), ("5m",)), WF.spread_contents(odd, ("5m",))))
    assert {k[0] for k in got} == {"m", "n", None} and got == {k: want[k] for k in got}
    assert {r["amt_median"] for k, r in got.items() if k[0] is None} == {0}


def test_features_of_bounded_hours_take_no_deltas_of_items(spark, tiny, monkeypatch):
    from surgelens.sources import fixtures as fx
    for name in ("item_steps", "neighbour_steps", "bucket_cells"):
        monkeypatch.setattr(WF, name, lambda *a: pytest.fail("a bounded tile was spread"))
    events = fx.annotated(spark, tiny).filter("merchant_id = 'm_1'")
    assert WF.window_features(events, ("1m", "5m")).count() > 100


def test_attempts_travel_packed(spark, flat):
    """A merchant-hour's attempts of one task are one row, whatever their order, and each of them is there once."""
    packs = tiles.packed(flat.repartition(1), tiles.ENTITIES)
    hours = flat.groupBy("merchant_id", F.floor(F.col("m") / 60).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, packs.select("merchant_id", "hour", "n").collect())) == sorted(map(tuple, hours.collect()))
    assert len(tiles.dealt(packs).select("tile").collect()) == 2 * hours.count()


def test_a_pack_moves_once_to_each_block_of_tiles(spark, flat):
    packs = tiles.packed(flat, tiles.ENTITIES).cache()
    moved = []
    solve = lambda rows, first_end: {"window_size": ["1h"], "end_minute": [first_end], "n": [rows.num_rows]}
    whole, dealt = tiles.solved_all(packs, solve, "n long"), tiles.solved(tiles.dealt(packs), solve, "n long")
    assert sorted(whole.collect()) == sorted(dealt.collect())
    for df in (whole, dealt):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        moved.append(plan.count("Generate explode"))
    assert moved == [1, 1]
    hours = {(r.merchant_id, r.hour) for r in packs.collect()}
    rows = packs.count()
    twice = sum(1 for r in packs.collect() if r.hour // tiles.BLOCK != (r.hour + 1) // tiles.BLOCK)
    assert hours and rows + twice < 2 * rows
