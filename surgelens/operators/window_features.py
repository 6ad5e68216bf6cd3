"""Families A-I for every merchant-window in one job.

Plan: events collapse to minutes; counts and sums slide by deltas. What needs a window's contents (items and their
neighbours, gaps, order statistics, amount bins) comes from hour tiles (``tiles``), a bounded group each. Tiles of more attempts
are spread: there per-item counts (devices, states, ...) slide by deltas too and reach the window as a histogram "how many items have
value v", which yields distinct count, maximum, entropy and Gini together; order
statistics (median amount, 5th percentile gap) and the amount bins look at per-minute value counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from surgelens.functions.stats import block_rank_sum, entropy_bits, gini_from_ranks
from surgelens.operators import sweep, tiles
from surgelens.operators.grid import ALL_SIZES, HORIZONS, W, instant, minute, steps_of
from surgelens.session import hold
from surgelens.registry import FAMILY_FEATURES, col_of

COUNT_DIMS = ("country", "state", "method", "issuer", "bin", "decline", "dev", "cus")
_OPTIONAL = {"outcome_status": "string", "decline_source": "string", "failure_code": "string",
             "refunded_at": "timestamp"}


def _or(value: Column, fallback: Column) -> Column:
    return F.when(value.isNull() | (value == ""), fallback).otherwise(value)


def entity_columns() -> dict[str, Column]:
    """Entity ids; an unknown customer, device or IP is one anonymous entity per transaction."""
    txn = F.col("transaction_id")
    return {
        "cus": _or(F.col("customer_id"), F.concat(F.lit("anon_cus_"), txn)),
        "dev": _or(F.col("device_fp"), F.concat(F.lit("anon_dev_"), txn)),
        "ins": F.col("instrument_fp"),
        "ip": _or(F.col("ip_fp"), F.concat(F.lit("anon_ip_"), txn)),
    }


def flatten(events: DataFrame) -> DataFrame:
    """The columns features need, one flat row per attempt."""
    for name, kind in _OPTIONAL.items():
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    return events.select(
        "merchant_id", minute("timestamp").alias("m"), F.unix_micros("timestamp").alias("us"),
        *[c.alias(n) for n, c in entity_columns().items()],
        F.col("amount").cast("decimal(14,2)").alias("amount"),
        F.col("geo.country").alias("country"), _or(F.col("geo.state"), F.lit("UNKNOWN")).alias("state"),
        _or(F.col("geo.city"), F.lit("UNKNOWN")).alias("city"),
        F.col("payment_method").alias("method"),
        _or(F.col("instrument_meta.issuer_country"), F.lit("IN")).alias("issuer"),
        _or(F.col("instrument_meta.bin_hash"), F.lit("UNKNOWN")).alias("bin"),
        F.when(F.col("failure_code") != "", F.col("failure_code")).alias("decline"),
        F.col("outcome_status").alias("status"), "decline_source",
        F.col("refunded_at").isNotNull().alias("refunded"),
        F.col("coupon_id").isNotNull().alias("coupon"),
        (F.coalesce(F.col("is_cod"), F.lit(False)) | (F.col("payment_method") == "COD")).alias("cod"),
        (F.coalesce(F.col("attempt_number"), F.lit(1)) > 1).alias("retry"))


def minute_panes(flat: DataFrame) -> DataFrame:
    """Additive facts per merchant and minute."""
    amt = F.col("amount")
    return flat.groupBy("merchant_id", "m").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status").isin("CAPTURED", "AUTHORIZED")).alias("success"),
        F.count_if(F.col("status") == "FAILED").alias("failure"),
        F.count_if(F.col("decline_source") == "ISSUER").alias("issuer_declines"),
        F.count_if("refunded").alias("refunds"),
        F.count_if("coupon").alias("coupons"), F.count_if("cod").alias("cod"),
        F.count_if(F.col("country") != "IN").alias("intl"), F.count_if("retry").alias("retries"),
        F.count_if(F.col("method") == "CARD").alias("card"),
        F.count_if(amt < 100).alias("low"), F.count_if(amt > 10000).alias("high"),
        F.sum(amt).cast("decimal(38,2)").alias("amt"),
        # exact sums of money and squares, so no cancellation when they are subtracted
        F.sum((amt * amt).cast("decimal(28,4)")).cast("decimal(38,4)").alias("amt_sq"))


ADDITIVE = ["n", "success", "failure", "issuer_declines", "refunds", "coupons", "cod", "intl",
            "retries", "card", "low", "high", "amt", "amt_sq"]


def gap_panes(flat: DataFrame) -> DataFrame:
    """Gaps between consecutive attempts of a merchant, counted per (previous minute, minute, gap).

    A merchant's attempts are never sorted in one task: gaps are found within a second, then
    between the seconds of a minute, then between minutes.
    """
    ev = flat.select("merchant_id", "m", F.floor(F.col("us") / 1000000).cast("long").alias("sec"), "us")
    in_sec = Window.partitionBy("merchant_id", "m", "sec").orderBy("us")
    in_min = Window.partitionBy("merchant_id", "m").orderBy("sec")
    in_all = Window.partitionBy("merchant_id").orderBy("m")
    within = (ev.withColumn("gap", F.col("us") - F.lag("us").over(in_sec)).filter("gap is not null")
              .groupBy("merchant_id", F.col("m").alias("m_prev"), "m", "gap").agg(F.count(F.lit(1)).alias("c")))
    secs = ev.groupBy("merchant_id", "m", "sec").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    between_secs = (secs.withColumn("gap", F.col("first") - F.lag("last").over(in_min)).filter("gap is not null")
                    .select("merchant_id", F.col("m").alias("m_prev"), "m", "gap", F.lit(1).cast("long").alias("c")))
    mins = secs.groupBy("merchant_id", "m").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    between_mins = (mins.withColumn("gap", F.col("first") - F.lag("last").over(in_all))
                    .withColumn("m_prev", F.lag("m").over(in_all)).filter("gap is not null")
                    .select("merchant_id", "m_prev", "m", "gap", F.lit(1).cast("long").alias("c")))
    return within.unionByName(between_secs).unionByName(between_mins)


def _gap_deltas(gaps: DataFrame, sizes: tuple[str, ...]) -> DataFrame:
    """A gap counts from the end after its later attempt until its earlier attempt leaves."""
    totals = gaps.groupBy("merchant_id", "m_prev", "m").agg(
        F.sum("c").alias("gaps"), F.sum(F.col("gap") * F.col("c")).cast("decimal(38,0)").alias("gap_us"),
        F.sum((F.col("gap").cast("decimal(14,0)") * F.col("gap").cast("decimal(14,0)")).cast("decimal(28,0)")
              * F.col("c").cast("decimal(9,0)")).cast("decimal(38,0)").alias("gap_sq"))
    sides = []
    for s in sizes:
        fits = F.col("m") - F.col("m_prev") < HORIZONS[s]
        for end, sign in ((F.col("m") + 1, 1), (F.col("m_prev") + HORIZONS[s] + 1, -1)):
            sides.append(F.when(fits, F.struct(F.lit(s).alias("window_size"), end.alias("end_minute"), F.lit(sign).alias("sign"))))
    return (totals.withColumn("_d", F.explode(F.array(*sides))).filter("_d is not null")
            .select("merchant_id", "_d.window_size", "_d.end_minute",
                    *[(F.col(c) * F.col("_d.sign")).cast("decimal(38,0)").alias(c) for c in ("gaps", "gap_us", "gap_sq")]))


def item_steps(flat: DataFrame, sizes: tuple[str, ...], dims: tuple[str, ...] = COUNT_DIMS) -> DataFrame:
    """Step functions (merchant, dim, item) -> attempts of the item in the window."""
    pairs = F.array(*[F.when(F.col(d).isNotNull(), F.struct(F.lit(d).alias("dim"), F.col(d).alias("item"))) for d in dims])
    panes = (flat.select("merchant_id", "m", F.explode(pairs).alias("_p")).filter("_p is not null")
             .groupBy("merchant_id", "_p.dim", "_p.item", "m").agg(F.count(F.lit(1)).alias("c")))
    return sweep.steps_from_panes(panes, ["merchant_id", "dim", "item"], "c", "value", sizes)


def edge_minutes(flat: DataFrame) -> DataFrame:
    """Distinct entity edges per merchant and minute: customer-device, device-instrument,
    customer-IP."""
    e = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    return (flat.select("merchant_id", "m", F.explode(F.array(e("cd", "cus", "dev"), e("di", "dev", "ins"),
                                                             e("ci", "cus", "ip"))).alias("_e"))
            .select("merchant_id", "_e.kind", "_e.a", "_e.b", "m").distinct())


# Which neighbour counts an edge kind feeds: (dimension, end of the edge that is counted for).
NEIGHBOUR_DIMS = {"cd": [("dev_cus", "b"), ("cus_dev", "a"), ("dev_deg", "b")],
                  "di": [("dev_ins", "a"), ("dev_deg", "a")],
                  "ci": [("ip_cus", "b"), ("cus_ip", "a")]}


def neighbour_steps(flat: DataFrame, sizes: tuple[str, ...],
                    dims: tuple[str, ...] = ("dev_cus", "dev_ins", "cus_dev", "ip_cus", "dev_deg")) -> DataFrame:
    """Step functions (merchant, dim, item) -> distinct neighbours of the item in the window."""
    deltas = sweep.presence_deltas(edge_minutes(flat), ["merchant_id", "kind", "a", "b"], sizes)
    sides = [F.when(F.col("kind") == kind, F.struct(F.lit(dim).alias("dim"), F.col(end).alias("item")))
             for kind, uses in NEIGHBOUR_DIMS.items() for dim, end in uses if dim in dims]
    oriented = (deltas.withColumn("_s", F.explode(F.array(*sides))).filter("_s is not null")
                .select("merchant_id", "_s.dim", "_s.item", "window_size", "end_minute", "delta"))
    return sweep.steps_from_deltas(oriented, ["merchant_id", "dim", "item"], "delta", "value")


def window_histogram(steps: DataFrame) -> DataFrame:
    """Item steps -> (W, dim, y, h): ``h`` items of the dimension have value ``y``."""
    moved = sweep.histogram_deltas(steps, ["merchant_id", "dim"], "value")
    return sweep.expand_steps(sweep.steps_from_deltas(moved, ["merchant_id", "dim", "y"], "delta", "h"),
                              ["merchant_id", "dim", "y"], "h")


def profile(hist: DataFrame) -> DataFrame:
    """Per window and dimension: items, total, top value, entropy and Gini, as wide columns."""
    present = [*W, "dim"]
    ordered = Window.partitionBy(*present).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    y, h = F.col("y"), F.col("h")
    ranked = (hist.repartition(*W)
              .withColumn("_before", F.sum("h").over(ordered) - h)
              .groupBy(*present)
              .agg(F.sum("h").alias("items"), F.sum(y * h).alias("total"), F.max("y").alias("top"),
                   F.sum(h * y * F.log2(y.cast("double"))).alias("plogp"),
                   F.sum(block_rank_sum(y, h, F.col("_before"))).alias("ranks")))
    n, t = F.col("items"), F.col("total")
    ent, gin = entropy_bits(t, F.col("plogp")), gini_from_ranks(n, t.cast("double"), F.col("ranks"))
    wanted = {"items": (n, ("cus", "dev", "dev_cus")),
              "total": (t, ("dev_cus",)),
              "top": (F.col("top"), ("dev", "cus", "decline", "dev_cus", "dev_ins", "cus_dev", "ip_cus")),
              "ent": (ent, ("country", "state", "method", "issuer", "decline")),
              "gini": (gin, ("state", "bin", "dev_cus", "dev_deg"))}
    aggs = [F.max(F.when(F.col("dim") == d, expr)).alias(f"{name}_{d}")
            for name, (expr, dims) in wanted.items() for d in dims]
    return ranked.groupBy(*W).agg(*aggs)


def distinct_deltas(flat: DataFrame, kinds: dict[str, Column], sizes: tuple[str, ...],
                    known: DataFrame | None = None) -> DataFrame:
    """Deltas of the number of distinct entities per kind, one column per kind.

    ``kinds`` maps a column name to the entity (null: none). With ``known`` (merchant_id,
    kind, entity) only entities not in it are counted.
    """
    each = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("entity")) for k, c in kinds.items()])
    occ = (flat.select("merchant_id", "m", F.explode(each).alias("_e"))
           .select("merchant_id", "_e.kind", "_e.entity", "m").filter("entity is not null").distinct())
    if known is not None:
        occ = occ.join(known, ["merchant_id", "kind", "entity"], "left_anti")
    moved = sweep.presence_deltas(occ, ["merchant_id", "kind", "entity"], sizes)
    return (moved.groupBy("merchant_id", "window_size", "end_minute")
            .agg(*[F.sum(F.when(F.col("kind") == k, F.col("delta")).otherwise(0)).alias(k) for k in kinds]))


# ---- order statistics and amount bins -------------------------------------------------
# A window's values are first seen as counts per value bucket, which slide by deltas. Only
# buckets that hold a wanted rank, or that straddle a bin edge, are opened; their values meet
# the window on (merchant, horizon, bucket, time block), a block being as long as the horizon.

BUCKETS_PER_OCTAVE = 16


def _bucket(value: Column) -> Column:
    return F.when(value > 0, F.floor(F.log2(value.cast("double")) * BUCKETS_PER_OCTAVE)).otherwise(-1).cast("int")


def value_panes(flat: DataFrame, gaps: DataFrame) -> DataFrame:
    """Counts per (dim, m_prev, m, value); dim ``amount`` in hundredths, ``gap`` in microseconds."""
    amounts = (flat.groupBy("merchant_id", "m", (F.col("amount") * 100).cast("long").alias("value"))
               .agg(F.count(F.lit(1)).alias("c"))
               .select("merchant_id", F.lit("amount").alias("dim"), F.col("m").alias("m_prev"), "m", "value", "c"))
    return (amounts.unionByName(gaps.select("merchant_id", F.lit("gap").alias("dim"), "m_prev", "m",
                                            F.col("gap").alias("value"), "c"))
            .withColumn("bucket", _bucket(F.col("value"))))


def bucket_cells(values: DataFrame, sizes: tuple[str, ...]) -> DataFrame:
    """(W, dim, bucket, weight): how many values of the window lie in each bucket."""
    keys = ["merchant_id", "dim", "bucket"]
    panes = values.groupBy(*keys, "m_prev", "m").agg(F.sum("c").alias("c")).repartition(*keys)
    sides = []
    for s in sizes:
        fits = F.col("m") - F.col("m_prev") < HORIZONS[s]
        for end, sign in ((F.col("m") + 1, 1), (F.col("m_prev") + HORIZONS[s] + 1, -1)):
            sides.append(F.when(fits, F.struct(F.lit(s).alias("window_size"), end.alias("end_minute"),
                                               (F.col("c") * sign).alias("d"))))
    deltas = (panes.withColumn("_d", F.explode(F.array(*sides))).filter("_d is not null")
              .select(*keys, "_d.window_size", "_d.end_minute", "_d.d"))
    return sweep.expand_steps(sweep.steps_from_deltas(deltas, keys, "d", "weight", combine=False), keys, "weight")


def open_buckets(targets: DataFrame, values: DataFrame, sizes: tuple[str, ...], keep: list[str]) -> DataFrame:
    """Values of the targeted (W, dim, bucket) cells, with the target's ``keep`` columns."""
    lengths = F.array(*[F.struct(F.lit(s).alias("window_size"), F.lit(HORIZONS[s]).alias("steps")) for s in sizes])
    blocked = (values.withColumn("_s", F.explode(lengths))
               .select("merchant_id", "dim", "bucket", "_s.window_size", "m_prev", "m", "value", "c",
                       F.floor(F.col("m") / F.col("_s.steps")).alias("_block")))
    steps = steps_of("window_size")
    first, last = F.floor((F.col("end_minute") - steps) / steps), F.floor((F.col("end_minute") - 1) / steps)
    asked = (targets.select(*W, "dim", "bucket", *keep, (F.col("end_minute") - steps).alias("_start"),
                            F.explode(F.array_distinct(F.array(first, last))).alias("_block")))
    return (asked.join(blocked, ["merchant_id", "window_size", "dim", "bucket", "_block"])
            .filter((F.col("m") < F.col("end_minute")) & (F.col("m_prev") >= F.col("_start")))
            .select(*W, "dim", "bucket", "value", "c", *keep))


def order_statistics(cells: DataFrame, values: DataFrame, sizes: tuple[str, ...]) -> DataFrame:
    """Median amount and the gap at sorted index int(0.05 * gaps), per window."""
    per_w = Window.partitionBy(*W, "dim")
    upto = per_w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    n, is_amt = F.col("n_total"), F.col("dim") == "amount"
    low5 = F.floor(F.lit(0.05) * n) + 1
    targets = (cells.withColumn("_cum", F.sum("weight").over(upto)).withColumn("n_total", F.sum("weight").over(per_w))
               .withColumn("lo", F.when(is_amt, F.floor((n + 1) / 2)).otherwise(low5))
               .withColumn("hi", F.when(is_amt, F.floor(n / 2) + 1).otherwise(low5))
               .withColumn("before", F.col("_cum") - F.col("weight"))
               .filter((F.col("before") < F.col("hi")) & (F.col("_cum") >= F.col("lo"))))
    inside = (Window.partitionBy(*W, "dim", "bucket").orderBy("value")
              .rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("before") + F.sum("c").over(inside)
    picked = (open_buckets(targets, values, sizes, ["before", "lo", "hi"])
              .withColumn("_rank", rank)
              .groupBy(*W, "dim")
              .agg(F.min(F.when(F.col("_rank") >= F.col("lo"), F.col("value"))).alias("at_lo"),
                   F.min(F.when(F.col("_rank") >= F.col("hi"), F.col("value"))).alias("at_hi")))
    mid = (F.col("at_lo") + F.col("at_hi")) / 2
    return picked.groupBy(*W).agg(F.max(F.when(is_amt, mid / 100)).alias("amt_median"),
                                  F.max(F.when(~is_amt, mid / 1000000)).alias("gap_p05"))


def amount_bins(cells: DataFrame, values: DataFrame, base: DataFrame, sizes: tuple[str, ...]) -> DataFrame:
    """Entropy of amounts over ten bins scaled to twice the window's mean."""
    scale = F.greatest(F.lit(100.0), F.col("amt").cast("double") / F.greatest(F.lit(1), F.col("n")) * 2.0)
    bin_of = lambda amount, width: F.least(F.lit(9), F.floor(amount / width * 10))
    # bucket bounds, widened a little so that rounding can only cause an extra look
    low = F.when(F.col("bucket") < 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col("bucket") / BUCKETS_PER_OCTAVE) / 100 * (1 - 1e-9))
    high = F.when(F.col("bucket") < 0, 0.0).otherwise(F.pow(F.lit(2.0), (F.col("bucket") + 1) / BUCKETS_PER_OCTAVE) / 100 * (1 + 1e-9))
    placed = (cells.filter(F.col("dim") == "amount").join(base.select(*W, scale.alias("scale")), W)
              .withColumn("_lo", bin_of(low, F.col("scale"))).withColumn("_hi", bin_of(high, F.col("scale"))))
    whole = placed.filter("_lo = _hi").select(*W, F.col("_lo").alias("_bin"), F.col("weight").alias("c"))
    split = open_buckets(placed.filter("_lo <> _hi"), values, sizes, ["scale"])
    split = split.select(*W, bin_of(F.col("value") / 100.0, F.col("scale")).alias("_bin"), "c")
    binned = whole.unionByName(split).groupBy(*W, "_bin").agg(F.sum("c").alias("_c"))
    c = F.col("_c")
    return (binned.groupBy(*W).agg(F.sum(c).alias("_n"), F.sum(c * F.log2(c.cast("double"))).alias("_p"))
            .select(*W, entropy_bits(F.col("_n"), F.col("_p")).alias("ent_amount")))


def mix_distance(flat: DataFrame, dim: str, mix: DataFrame, sizes: tuple[str, ...], out: str) -> DataFrame:
    """JS distance between the window's mix of ``dim`` and a baseline mix
    (merchant_id, category, share).

    Categories absent from the window contribute their baseline share, so only the
    categories present have to be looked up.
    """
    total = mix.groupBy("merchant_id").agg(F.sum("share").alias("_qt"))
    q = mix.join(total, "merchant_id").filter("_qt > 0").select(
        "merchant_id", F.col("category").alias("item"), (F.col("share") / F.col("_qt")).alias("_q"))
    known = q.select("merchant_id").distinct().withColumn("_has", F.lit(1))
    counts = sweep.expand_steps(item_steps(flat, sizes, (dim,)), ["merchant_id", "item"], "value")
    per_w = Window.partitionBy(*W)
    shares = (counts.join(known, "merchant_id").join(q, ["merchant_id", "item"], "left")
              .fillna(0.0, ["_q"]).withColumn("_p", F.col("value") / F.sum("value").over(per_w)))
    mid = (F.col("_p") + F.col("_q")) / 2
    inside = F.col("_p") * F.log2(F.col("_p") / mid) + F.when(F.col("_q") > 0, F.col("_q") * F.log2(F.col("_q") / mid)).otherwise(0.0)
    jsd = (F.sum(inside) + F.greatest(F.lit(0.0), 1.0 - F.sum("_q"))) / 2
    return shares.groupBy(*W).agg(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), jsd))).alias(out))


HISTORY_KINDS = {"cus": "customer", "dev": "device", "ins": "instrument", "ip": "ip"}


def novelty_deltas(flat: DataFrame, history: DataFrame, sizes: tuple[str, ...]) -> DataFrame:
    """Deltas of distinct window entities absent from ``history`` (merchant_id, kind, entity)."""
    columns = {kind: f"novel_{c}" for c, kind in HISTORY_KINDS.items()}
    renamed = history.select("merchant_id", F.concat(F.lit("novel_"), _short_kind(F.col("kind"))).alias("kind"), "entity")
    return distinct_deltas(flat, {columns[kind]: F.col(c) for c, kind in HISTORY_KINDS.items()}, sizes, renamed)


def _short_kind(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for short, long in HISTORY_KINDS.items():
        out = F.when(kind == long, short).otherwise(out)
    return out


def first_seen(events: DataFrame) -> DataFrame:
    """History table (merchant_id, kind, entity, first_seen) of known entities."""
    known = {"customer": "customer_id", "device": "device_fp", "instrument": "instrument_fp", "ip": "ip_fp"}
    each = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(c).alias("entity")))
                                     for k, c in known.items()]))
    return (events.select("merchant_id", "timestamp", F.explode(each).alias("_e"))
            .groupBy("merchant_id", "_e.kind", "_e.entity").agg(F.min("timestamp").alias("first_seen")))


def attempt_packs(flat: DataFrame) -> DataFrame:
    """The attempts as packed hours, held: what tiles of windows and of the graph are dealt from."""
    return hold(tiles.packed(flat.withColumn("cents", (F.col("amount") * 100).cast("long")), (*tiles.ENTITIES, *tiles.CATEGORIES, "cents")))


def _among(rows: DataFrame, wanted: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose keys are (``left_anti``: are not) wanted; a missing key is a key like any other."""
    named = wanted.select(*[F.col(k).alias(f"_of_{k}") for k in keys])
    return rows.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]), how)


def window_contents(flat: DataFrame, packs: DataFrame, sizes: tuple[str, ...], tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(W, ``tiles.CONTENTS``) of every non-empty window: bounded tiles in one task each, larger ones by deltas.

    Deltas also serve merchants with attempts without an instant, whose entities they keep counting; values of attempts without
    a merchant are in no order."""
    tile, dealt = ["merchant_id", "tile"], tiles.dealt(packs)
    solved = lambda packs, way=tiles.solved: way(packs, tiles.contents_of_tile(sizes), tiles.CONTENTS).withColumns(
        {c: F.when(F.col("merchant_id").isNotNull(), F.col(c)) for c in ("amt_median", "gap_p05", "ent_amount")})
    counts = dealt.groupBy(*tile).agg(F.sum("n").alias("_n"))
    undated = flat.filter("m is null").select("merchant_id").distinct()
    large = counts.filter(F.col("_n") > tile_rows).unionByName(_among(counts, undated, ["merchant_id"])).select(*tile).distinct()
    if large.isEmpty():
        return solved(packs, tiles.solved_all)
    hours = (large.select("merchant_id", F.explode(F.array("tile", F.col("tile") - 1)).alias("_h"))
             .unionByName(undated.withColumn("_h", F.lit(None).cast("long"))).distinct())
    part = hold(_among(flat.withColumn("_h", F.floor(F.col("m") / tiles.TILE)), hours, ["merchant_id", "_h"]).drop("_h"))
    spread = _among(spread_contents(part, sizes).withColumn("tile", F.floor((F.col("end_minute") - 1) / tiles.TILE)), large, tile)
    out = solved(_among(dealt, large, tile, "left_anti"))
    return out.unionByName(spread.select(*[F.col(f.name).cast(f.dataType) for f in out.schema.fields]))


def spread_contents(flat: DataFrame, sizes: tuple[str, ...]) -> DataFrame:
    """``window_contents`` of windows of any size, by deltas of items, edges, gaps and values."""
    gaps = gap_panes(flat)
    uniques = {"items_ins": F.col("ins"), "items_ip": F.col("ip"), "foreign": F.when(F.col("country") != "IN", F.col("country"))}
    extra = _gap_deltas(gaps, sizes).unionByName(distinct_deltas(flat, uniques, sizes), allowMissingColumns=True)
    base = hold(sweep.sliding_sums(minute_panes(flat).select("merchant_id", "m", "n", "amt"), ["merchant_id"], ["n", "amt"], sizes, extra=extra))
    hist = window_histogram(item_steps(flat, sizes).unionByName(neighbour_steps(flat, sizes)))
    values = value_panes(flat, gaps)
    cells = hold(bucket_cells(values, sizes))
    parts = [base, profile(hist), order_statistics(cells, values, sizes), amount_bins(cells, values, base, sizes)]
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return joined.groupBy(*W).agg(*[F.max(c).alias(c) for c in joined.columns if c not in W])


def window_features(events: DataFrame, sizes: tuple[str, ...] = ALL_SIZES, history: DataFrame | None = None,
                    geo_mix: DataFrame | None = None, method_mix: DataFrame | None = None,
                    spine: DataFrame | None = None, preceding: bool = False, tile_rows: int = tiles.TILE_ROWS,
                    flat: DataFrame | None = None, packs: DataFrame | None = None) -> DataFrame:
    """Wide feature rows (families A-I) for every non-empty merchant-window, or for every
    window of ``spine`` (merchant_id, window_size, end_minute).

    ``history``, ``geo_mix`` and ``method_mix`` are optional, as is the rate of the preceding
    window; without them novelty is 1, mix distances are 0 and the preceding rate is 0. ``flat`` and ``packs``: the events as
    ``flatten`` and ``attempt_packs`` make them, if they are there already.
    """
    flat = hold(flatten(events)) if flat is None else flat
    packs = attempt_packs(flat) if packs is None else packs
    extra = novelty_deltas(flat, history, sizes) if history is not None else None
    base = sweep.sliding_sums(minute_panes(flat), ["merchant_id"], ADDITIVE, sizes, spine, ("n",) if preceding else (), extra)
    parts = [base.withColumn("_on", F.lit(1)), window_contents(flat, packs, sizes, tile_rows)]
    if geo_mix is not None:
        parts.append(mix_distance(flat, "city", geo_mix, sizes, "geo_jsd"))
    if method_mix is not None:
        parts.append(mix_distance(flat, "method", method_mix, sizes, "method_jsd"))
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    cols = [c for c in joined.columns if c not in W]
    wide = joined.groupBy(*W).agg(*[F.max(c).alias(c) for c in cols]).filter("_on = 1")
    for name in ("geo_jsd", "method_jsd", "prev_n"):
        if name not in cols:
            wide = wide.withColumn(name, F.lit(0.0))
    for c in HISTORY_KINDS:
        if f"novel_{c}" not in cols:
            wide = wide.withColumn(f"novel_{c}", F.col(f"items_{c}"))
    return _assemble(wide)


def _assemble(wide: DataFrame) -> DataFrame:
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    seconds = (steps_of("window_size") * 60).cast("double")
    n, gaps = d("n"), d("gaps")
    n1 = F.greatest(F.lit(1.0), n)  # divisors stay positive on empty windows
    # n * sum(x^2) - sum(x)^2 is subtracted in exact decimals
    def std(sq: str, total: str, count: str) -> Column:
        k = d(count)
        spread = (F.col(sq) * F.col(count).cast("decimal(18,0)") - F.col(total) * F.col(total)).cast("double")
        return F.when(k > 1, F.sqrt(spread / F.greatest(F.lit(1.0), k) / F.greatest(F.lit(1.0), k - 1))).otherwise(0.0)

    amt_std = std("amt_sq", "amt", "n")
    mean_amt = d("amt") / n1
    gap_mean = F.when(gaps > 0, d("gap_us") / F.greatest(F.lit(1.0), gaps) / 1e6).otherwise(seconds / F.greatest(F.lit(1.0), n))
    gap_std = std("gap_sq", "gap_us", "gaps") / 1e6
    cv = F.when(gaps > 0, gap_std / F.greatest(F.lit(1e-4), gap_mean)).otherwise(1.0)
    devs, cuss, inss, ips = d("items_dev"), d("items_cus"), d("items_ins"), d("items_ip")
    at_least_one = lambda c: F.greatest(F.lit(1.0), c)
    zero = F.lit(0.0)
    values = {
        "A.txn_rate": n / (seconds / 60), "A.rate_accel": (n - d("prev_n")) / (seconds / 60),
        "A.burst_duration": zero, "A.interarrival_mean": gap_mean, "A.interarrival_cv": cv,
        "A.interarrival_p05": F.coalesce(F.col("gap_p05"), gap_mean),
        "A.periodicity_score": F.greatest(zero, 1.0 - F.least(F.lit(1.0), cv)), "A.hour_of_week_dev": zero,
        "B.txn_count": n, "B.success_count": d("success"), "B.failure_count": d("failure"),
        "B.unique_customers": cuss, "B.unique_instruments": inss, "B.unique_devices": devs, "B.unique_ips": ips,
        "C.failure_rate": d("failure") / n1, "C.devices_per_txn": devs / n1, "C.accounts_per_txn": cuss / n1,
        "C.instruments_per_txn": inss / n1, "C.ips_per_txn": ips / n1,
        "C.instrument_novelty": d("novel_ins") / at_least_one(inss),
        "C.account_novelty": d("novel_cus") / at_least_one(cuss),
        "C.device_novelty": d("novel_dev") / at_least_one(devs),
        "C.coupon_rate": d("coupons") / n1, "C.cod_rate": d("cod") / n1,
        "C.international_rate": d("intl") / n1, "C.retry_rate": d("retries") / n1,
        "D.gmv": d("amt"), "D.amount_median": d("amt_median"), "D.amount_cv": amt_std / at_least_one(mean_amt),
        "D.amount_entropy": d("ent_amount"), "D.low_value_ratio": d("low") / n1, "D.high_value_ratio": d("high") / n1,
        "D.discount_to_gmv": d("coupons") * 100.0 / at_least_one(d("amt")),
        "E.country_entropy": d("ent_country"), "E.state_entropy": d("ent_state"), "E.geo_mix_jsd": d("geo_jsd"),
        "E.new_country_count": d("foreign"), "E.geo_gini": d("gini_state"), "E.geo_transition_rate": zero,
        "F.accounts_per_device_max": d("top_dev_cus"),
        "F.accounts_per_device_mean": d("total_dev_cus") / at_least_one(d("items_dev_cus")),
        "F.accounts_per_device_gini": d("gini_dev_cus"), "F.txn_per_device_max": d("top_dev"),
        "F.instruments_per_device_max": d("top_dev_ins"), "F.device_reuse_rate": 1.0 - devs / n1,
        "G.account_age_median": F.lit(168.0), "G.account_age_p10": F.lit(24.0),
        "G.new_account_rate": d("novel_cus") / at_least_one(cuss), "G.txn_per_account_max": d("top_cus"),
        "G.accounts_per_address_max": F.lit(1.0), "G.account_cohort_concentration": d("novel_cus") / n1,
        "H.method_entropy": d("ent_method"), "H.method_mix_jsd": d("method_jsd"), "H.card_share": d("card") / n1,
        "H.issuer_country_entropy": d("ent_issuer"), "H.bin_prefix_gini": d("gini_bin"),
        "H.instrument_repeat_rate": n / at_least_one(inss),
        "I.decline_code_entropy": d("ent_decline"),
        "I.decline_code_top_share": d("top_decline") / at_least_one(d("failure")),
        "I.decline_issuer_share": d("issuer_declines") / at_least_one(d("failure")),
        "I.refund_rate": d("refunds") / n1,
        "I.refund_latency_median": F.when(d("refunds") > 0, 4.0).otherwise(0.0),
        "I.refund_cohort_concentration": zero, "I.dispute_rate": zero, "I.rto_rate": zero, "I.chargeback_rate": zero,
        "J.devices_per_account_max": d("top_cus_dev"), "J.accounts_per_ip_max": d("top_ip_cus"),
        "J.bipartite_gini": d("gini_dev_deg"),
        "J.entity_novelty_share": (d("novel_cus") + d("novel_dev") + d("novel_ins") + d("novel_ip"))
        / at_least_one(cuss + devs + inss + ips),
    }
    when_empty = {"A.interarrival_mean": seconds, "A.interarrival_p05": seconds,
                  "J.devices_per_account_max": F.lit(1.0), "J.accounts_per_ip_max": F.lit(1.0)}
    ordered = [f"{fam}.{x}" for fam, names in FAMILY_FEATURES.items() for x in names if f"{fam}.{x}" in values]
    return wide.select(
        "merchant_id", "window_size", instant("end_minute").alias("window_end"),
        *[F.when(n > 0, values[f]).otherwise(when_empty.get(f, zero)).alias(col_of(f)) for f in ordered])


def additive_features(events: DataFrame, sizes: tuple[str, ...] = ALL_SIZES, spine: DataFrame | None = None,
                      preceding: bool = False, flat: DataFrame | None = None) -> DataFrame:
    """The features that are ratios of window sums; one shuffle of minutes, nothing else. ``flat``: the events as ``flatten`` makes them, if they are there already."""
    w = sweep.sliding_sums(minute_panes(flatten(events) if flat is None else flat), ["merchant_id"], ADDITIVE, sizes, spine, ("n",) if preceding else ())
    d = lambda c: F.col(c).cast("double")
    n, minutes = d("n"), steps_of("window_size").cast("double")
    prev = d("prev_n") if preceding else F.lit(0.0)
    share = lambda c, of=None: F.when(n > 0, d(c) / F.greatest(F.lit(1.0), n if of is None else of)).otherwise(0.0)
    return w.select(
        "merchant_id", "window_size", instant("end_minute").alias("window_end"), (n / minutes).alias("A_txn_rate"),
        F.when(n > 0, (n - prev) / minutes).otherwise(0.0).alias("A_rate_accel"), n.alias("B_txn_count"), d("success").alias("B_success_count"),
        d("failure").alias("B_failure_count"), share("failure").alias("C_failure_rate"), share("coupons").alias("C_coupon_rate"),
        share("cod").alias("C_cod_rate"), share("intl").alias("C_international_rate"), share("retries").alias("C_retry_rate"), d("amt").alias("D_gmv"),
        share("low").alias("D_low_value_ratio"), share("high").alias("D_high_value_ratio"),
        (d("coupons") * 100.0 / F.greatest(F.lit(1.0), d("amt"))).alias("D_discount_to_gmv"), share("card").alias("H_card_share"),
        share("issuer_declines", d("failure")).alias("I_decline_issuer_share"), share("refunds").alias("I_refund_rate"))


def novelty_features(events: DataFrame, history: DataFrame, sizes: tuple[str, ...] = ALL_SIZES) -> DataFrame:
    """Shares of window entities absent from a history (merchant_id, kind, entity)."""
    flat = flatten(events)
    panes = flat.groupBy("merchant_id", "m").agg(F.count(F.lit(1)).alias("n"))
    uniques = {f"items_{c}": F.col(c) for c in HISTORY_KINDS}
    extra = distinct_deltas(flat, uniques, sizes).unionByName(novelty_deltas(flat, history, sizes), allowMissingColumns=True)
    w = sweep.sliding_sums(panes, ["merchant_id"], ["n"], sizes, extra=extra)
    part = lambda c: F.col(f"novel_{c}") / F.greatest(F.lit(1), F.col(f"items_{c}"))
    total = lambda p: sum((F.col(f"{p}_{c}") for c in HISTORY_KINDS), F.lit(0))
    return w.select("merchant_id", "window_size", instant("end_minute").alias("window_end"), part("ins").alias("C_instrument_novelty"),
                    part("cus").alias("C_account_novelty"), part("dev").alias("C_device_novelty"),
                    (F.col("novel_cus") / F.col("n")).alias("G_account_cohort_concentration"), (total("novel") / total("items")).alias("J_entity_novelty_share"))


def mix_features(events: DataFrame, geo_mix: DataFrame, method_mix: DataFrame, sizes: tuple[str, ...] = ALL_SIZES) -> DataFrame:
    """JS distances of the window's city and method mixes from baseline mixes."""
    flat = flatten(events)
    a = mix_distance(flat, "city", geo_mix, sizes, "E_geo_mix_jsd")
    b = mix_distance(flat, "method", method_mix, sizes, "H_method_mix_jsd")
    return a.join(b, W, "full").select("merchant_id", "window_size", instant("end_minute").alias("window_end"), "E_geo_mix_jsd", "H_method_mix_jsd")


def baseline_mix(events: DataFrame, category) -> DataFrame:
    """Share of each category among a merchant's attempts."""
    counts = events.groupBy("merchant_id", category.alias("category")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("merchant_id").agg(F.sum("c").alias("t"))
    return counts.join(total, "merchant_id").select("merchant_id", "category", (F.col("c") / F.col("t")).alias("share"))


def declared_features(events: DataFrame, customers: DataFrame, sizes: tuple[str, ...] = ALL_SIZES) -> DataFrame:
    """Shares as the registry words them, for the columns that exist: refund rate, young-account share (24 h), and the
    share of accounts outside their own modal region. Ages, latencies and cohorts: ``declared_statistics``."""
    flat_ids = events.select("merchant_id", "transaction_id", "customer_id", "timestamp", "refunded_at", F.col("geo.state").alias("state"))
    mode = flat_ids.filter("customer_id is not null").groupBy("customer_id").agg(F.mode("state", True).alias("home_state"))
    hours = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 3.6e9
    facts = (flat_ids.join(customers, "customer_id", "left").join(mode, "customer_id", "left")
             .select("merchant_id", minute("timestamp").alias("m"), "customer_id", hours("timestamp", "created_at").alias("age_hours"),
                     hours("refunded_at", "timestamp").alias("refund_hours"), (F.col("state") != F.col("home_state")).alias("away")))
    panes = facts.groupBy("merchant_id", "m").agg(
        F.count(F.lit(1)).alias("n"), F.count("refund_hours").alias("refunds"), F.count_if(F.col("age_hours") < 24).alias("young"),
        F.count_if("away").alias("away"), F.count("customer_id").alias("known"))
    w = sweep.sliding_sums(panes, ["merchant_id"], ["n", "refunds", "young", "away", "known"], sizes)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return w.select("merchant_id", "window_size", instant("end_minute").alias("window_end"), share("refunds", "n").alias("refund_rate"),
                    share("young", "known").alias("young_account_share"), share("away", "known").alias("away_from_home_share"))


def burst_duration(windows: DataFrame, above: Column) -> DataFrame:
    """Seconds since the window's run of ends above its baseline began (0 at its first end, and where it is not above).

    ``windows`` holds every end of the grid per merchant and horizon (the spine), ``above`` says whether the rate exceeds the baseline by
    three MADs. The last end that was not above is carried forward: over hours first, then within each hour."""
    key = ["merchant_id", "window_size"]
    rows = windows.withColumn("_e", minute("window_end")).withColumn("_above", F.coalesce(above, F.lit(False))).withColumn("_h", F.floor(F.col("_e") / 60))
    calm = F.when(~F.col("_above"), F.col("_e"))
    hours = rows.groupBy(*key, "_h").agg(F.max(calm).alias("_calm"), F.min("_e").alias("_first"))
    before = Window.partitionBy(*key).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(*key, "_h", F.max("_calm").over(before).alias("_before"), F.min("_first").over(Window.partitionBy(*key)).alias("_first"))
    inside = Window.partitionBy(*key, "_h").orderBy("_e").rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.coalesce(F.max(calm).over(inside), F.col("_before")) + 1, F.col("_first"))
    return (rows.join(hours, [*key, "_h"]).withColumn("_start", start)
            .select(*key, "window_end", F.when(F.col("_above"), (F.col("_e") - F.col("_start")) * 60.0).otherwise(0.0).alias("burst_duration")))


def window_quantiles(values: DataFrame, sizes: tuple[str, ...], asked: dict[str, tuple[str, float]]) -> DataFrame:
    """Interpolated quantiles per window: name -> (dim, q), one column each. ``values`` as ``value_panes`` makes them.

    Only the buckets that hold a wanted rank are opened, so no window's values are ever sorted as a whole."""
    values = hold(values)
    cells = bucket_cells(values, sizes)
    per_w = Window.partitionBy(*W, "dim")
    upto = per_w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array_compact(F.array(*[F.when(F.col("dim") == dim, F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"))) for name, (dim, q) in asked.items()]))
    at = F.col("_q.q") * (F.col("n_total") - 1)
    targets = (cells.withColumn("_cum", F.sum("weight").over(upto)).withColumn("n_total", F.sum("weight").over(per_w)).withColumn("_q", F.explode(wanted))
               .withColumn("lo", F.floor(at) + 1).withColumn("hi", F.ceil(at) + 1).withColumn("share", at - F.floor(at))
               .withColumn("name", F.col("_q.name")).withColumn("before", F.col("_cum") - F.col("weight"))
               .filter((F.col("before") < F.col("hi")) & (F.col("_cum") >= F.col("lo"))))
    inside = Window.partitionBy(*W, "name", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("before") + F.sum("c").over(inside)
    first = lambda bound: F.min(F.when(F.col("_rank") >= F.col(bound), F.col("value"))).cast("double")
    picked = (open_buckets(targets, values, sizes, ["name", "before", "lo", "hi", "share"]).withColumn("_rank", rank)
              .groupBy(*W, "name").agg(first("lo").alias("_lo"), first("hi").alias("_hi"), F.first("share").alias("_share")))
    value = F.col("_lo") + F.col("_share") * (F.col("_hi") - F.col("_lo"))
    return picked.groupBy(*W).agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in asked])


def _largest_share(steps: DataFrame, out: str) -> DataFrame:
    """(W, largest value over the window's items, their total) of step functions (merchant, dim, item)."""
    keys = ["merchant_id", "dim", "item"]
    each = sweep.expand_steps(steps, keys, "value").groupBy(*W, "dim").agg(F.max("value").alias("_top"), F.sum("value").alias("_all"))
    return each.groupBy(*W).agg(F.max(F.col("_top") / F.col("_all")).alias(out))


def declared_statistics(events: DataFrame, customers: DataFrame, sizes: tuple[str, ...] = ALL_SIZES) -> DataFrame:
    """Account ages, refund latency and cohort shares as the registry words them, per non-empty window.

    Median and tenth percentile of the account age at the attempt (hours); median hours from attempt to refund; largest share of the window's
    accounts that were created in one hour; largest share of its refunds on one account or one device. Attempts without the column in question do
    not count; where none is left the value is 0."""
    rows = events.select("merchant_id", "customer_id", "device_fp", minute("timestamp").alias("m"), F.unix_micros("timestamp").alias("us"), F.unix_micros("refunded_at").alias("refund_us"))
    rows = hold(rows.join(customers.select("customer_id", F.unix_micros("created_at").alias("created_us")), "customer_id", "left"))
    kinds = F.array(F.struct(F.lit("age").alias("dim"), (F.col("us") - F.col("created_us")).alias("value")), F.struct(F.lit("refund").alias("dim"), (F.col("refund_us") - F.col("us")).alias("value")))
    values = (rows.select("merchant_id", "m", F.explode(kinds).alias("_k")).select("merchant_id", "_k.dim", "m", "_k.value").filter("value is not null")
              .groupBy("merchant_id", "dim", F.col("m").alias("m_prev"), "m", "value").agg(F.count(F.lit(1)).alias("c")).withColumn("bucket", _bucket(F.col("value"))))
    quantiles = window_quantiles(values, sizes, {"account_age_median": ("age", 0.5), "account_age_p10": ("age", 0.1), "refund_latency_median": ("refund", 0.5)})
    born = rows.filter("created_us is not null").select("merchant_id", F.lit("born").alias("dim"), F.floor(F.col("created_us") / 3600000000).cast("string").alias("item"), "customer_id", "m").distinct()
    keys = ["merchant_id", "dim", "item"]
    moved = sweep.presence_deltas(born, [*keys, "customer_id"], sizes)
    cohorts = _largest_share(sweep.steps_from_deltas(moved.select(*keys, "window_size", "end_minute", "delta"), keys, "delta", "value"), "account_cohort_concentration")
    sides = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("item")) for c in ("customer_id", "device_fp")])
    refunds = rows.filter("refund_us is not null")
    back = (refunds.select("merchant_id", "m", F.explode(sides).alias("_s")).select("merchant_id", "_s.dim", F.coalesce("_s.item", F.lit("")).alias("item"), "m")
            .groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("c")))
    # an unknown account or device is no cohort, but its refunds count in the total
    known = sweep.expand_steps(sweep.steps_from_panes(back, keys, "c", "value", sizes), keys, "value")
    each = known.groupBy(*W, "dim").agg(F.max(F.when(F.col("item") != "", F.col("value"))).alias("_top"), F.sum("value").alias("_all"))
    refund_cohorts = each.groupBy(*W).agg(F.max(F.coalesce("_top", F.lit(0)) / F.col("_all")).alias("refund_cohort_concentration"))
    base = sweep.sliding_sums(rows.groupBy("merchant_id", "m").agg(F.count(F.lit(1)).alias("n")), ["merchant_id"], ["n"], sizes)
    out = reduce(lambda a, b: a.join(b, W, "left"), [base, quantiles, cohorts, refund_cohorts])
    d = lambda c, per=1.0: (F.coalesce(F.col(c), F.lit(0.0)) / per).alias(c)
    hour = 3.6e9
    return out.select("merchant_id", "window_size", instant("end_minute").alias("window_end"), d("account_age_median", hour), d("account_age_p10", hour), d("refund_latency_median", hour),
                      d("account_cohort_concentration"), d("refund_cohort_concentration"))


LAGS = 5


def lagged_gaps(flat: DataFrame, lags: int = LAGS) -> DataFrame:
    """(merchant_id, k, m_prev, m, c, p, s): for lag k, pairs of gaps that lie k apart: their number, sum of products and sum of both; m_prev
    is the minute of the earliest attempt of a pair, m that of the latest.

    Attempts are ordered within their minute; the last few of each minute are handed on to the merchant's next minutes, so a
    busy merchant is spread over its minutes."""
    need = lags + 1  # earlier attempts that the latest gap of a pair reaches back over
    ev = flat.select("merchant_id", "m", "us")
    minutes = ev.select("merchant_id", "m").distinct()
    order = Window.partitionBy("merchant_id").orderBy("m")
    nexts = minutes.withColumn("_to", F.array_compact(F.array(*[F.lead("m", j).over(order) for j in range(1, need + 1)]))).select("merchant_id", "m", F.explode("_to").alias("to"))
    tail = ev.withColumn("_r", F.row_number().over(Window.partitionBy("merchant_id", "m").orderBy(F.desc("us")))).filter(F.col("_r") <= need).drop("_r")
    carried = tail.join(nexts, ["merchant_id", "m"]).select("merchant_id", F.col("to").alias("block"), "m", "us")
    rows = ev.select("merchant_id", F.col("m").alias("block"), "m", "us").unionByName(carried)
    w = Window.partitionBy("merchant_id", "block").orderBy("us")
    back = lambda c, j: F.col(c) if j == 0 else F.lag(c, j).over(w)
    wide = rows.select("merchant_id", "block", "m", *[back("us", j).alias(f"u{j}") for j in range(need + 1)], *[back("m", j).alias(f"m{j}") for j in range(2, need + 1)]).filter("m = block")
    gap = lambda j: F.col(f"u{j}") - F.col(f"u{j + 1}")
    pairs = F.array(*[F.when(F.col(f"u{k + 1}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"m{k + 1}").alias("m_prev"), gap(0).alias("a"), gap(k).alias("b"))) for k in range(1, lags + 1)])
    d = lambda c: F.col(c).cast("decimal(18,0)")
    return (wide.select("merchant_id", "m", F.explode(pairs).alias("_p")).filter("_p is not null").select("merchant_id", "m", "_p.*")
            .groupBy("merchant_id", "k", "m_prev", "m").agg(F.count(F.lit(1)).alias("c"), F.sum((d("a") * d("b")).cast("decimal(36,0)")).cast("decimal(38,0)").alias("p"), F.sum(d("a") + d("b")).cast("decimal(38,0)").alias("s")))


def periodicity(events: DataFrame, sizes: tuple[str, ...] = ALL_SIZES, lags: int = LAGS) -> DataFrame:
    """Peak of the autocorrelation of a window's gaps over lags 1 to ``lags`` (0 at least), as the registry words it.

    Products of gaps k apart slide like counts: a pair enters a window after its latest attempt and leaves with its earliest. Fewer than two gaps
    give 0, gaps without any spread 1."""
    flat = hold(flatten(events))
    panes = flat.groupBy("merchant_id", "m").agg(F.count(F.lit(1)).alias("n"))
    sides = []
    for s in sizes:
        fits = F.col("m") - F.col("m_prev") < HORIZONS[s]
        for end, sign in ((F.col("m") + 1, 1), (F.col("m_prev") + HORIZONS[s] + 1, -1)):
            sides.append(F.when(fits, F.struct(F.lit(s).alias("window_size"), end.alias("end_minute"), F.lit(sign).alias("sign"))))
    deltas = lagged_gaps(flat, lags).withColumn("_d", F.explode(F.array(*sides))).filter("_d is not null")
    moved = deltas.groupBy("merchant_id", "_d.window_size", "_d.end_minute").agg(
        *[F.sum(F.when(F.col("k") == k, F.col(c) * F.col("_d.sign")).otherwise(0)).cast("decimal(38,0)").alias(f"{c}{k}") for k in range(1, lags + 1) for c in "cps"])
    extra = _gap_deltas(gap_panes(flat), sizes).unionByName(moved, allowMissingColumns=True)
    w = sweep.sliding_sums(panes, ["merchant_id"], ["n"], sizes, extra=extra)
    v = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    n, mean = v("gaps"), v("gap_us") / F.greatest(F.lit(1.0), v("gaps"))
    spread = v("gap_sq") - n * mean * mean
    at = [F.when(v(f"c{k}") > 0, (v(f"p{k}") - mean * v(f"s{k}") + v(f"c{k}") * mean * mean) / F.greatest(F.lit(1e-9), spread)) for k in range(1, lags + 1)]
    peak = F.when(n < 2, 0.0).when(spread <= 1e-12 * v("gap_sq"), 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.greatest(*at), F.lit(0.0))))
    return w.select("merchant_id", "window_size", instant("end_minute").alias("window_end"), peak.alias("periodicity_score"))
