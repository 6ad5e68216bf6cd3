"""Attempts dealt to hour tiles, and what a tile's windows hold.

A tile is a merchant's hour and the hour before, as much as any window that ends in the hour reaches back over. Attempts are first
packed: a task's attempts of one merchant-hour become one row of dictionary-encoded, compressed columns, so that dealing them
to two tiles moves a few bytes per attempt. A tile of at most ``TILE_ROWS`` attempts is one bounded group of numbers; its windows
are slices of arrays that are ordered by time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from surgelens.operators.grid import HORIZONS

#: minutes of a tile; attempts of a tile (its hour and the one before) that one task takes; attempts packed at a time
TILE, TILE_ROWS, PACK_ROWS = 60, 1_000_000, 250_000
#: tiles that are shuffled as one group and solved one after the other: a pack both of whose tiles lie in a block moves once
BLOCK = 2
_CODED = pa.ipc.IpcWriteOptions(compression="zstd")
#: the entity columns and the category columns of an attempt
ENTITIES, CATEGORIES = ("cus", "dev", "ins", "ip"), ("country", "state", "method", "issuer", "bin", "decline")


def _packed(table: pa.Table) -> pa.Table:
    """One row per merchant-hour: its attempts' columns as an Arrow stream."""
    names = table.column("merchant_id").combine_chunks().dictionary_encode(null_encoding="encode")
    merchant = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hour = table.column("m").to_numpy() // TILE
    order = np.lexsort((table.column("us").to_numpy(), hour, merchant))
    merchant, hour, table = merchant[order], hour[order], table.drop_columns(["merchant_id"]).take(order)
    starts = np.flatnonzero(np.r_[True, (np.diff(merchant) != 0) | (np.diff(hour) != 0)])
    blobs = []
    for at, end in zip(starts, np.r_[starts[1:], len(order)]):
        part = table.slice(at, end - at).combine_chunks()
        part = pa.table([c.combine_chunks().dictionary_encode() if pa.types.is_string(c.type) else c for c in part.columns], part.column_names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=_CODED) as out:
            out.write_table(part)
        blobs.append(sink.getvalue().to_pybytes())
    sizes = np.diff(np.r_[starts, len(order)])
    return pa.table([pa.array(names.dictionary.take(pa.array(merchant[starts])), pa.string()), pa.array(hour[starts], pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["merchant_id", "hour", "n", "attempts"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield from _packed(pa.Table.from_batches(kept)).to_batches()
            kept, n = [], 0
    if n:
        yield from _packed(pa.Table.from_batches(kept)).to_batches()


def packed(flat: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(merchant_id, hour, n, attempts): the attempts' ``m``, ``us`` and ``columns``. An attempt without an instant is in no window."""
    return (flat.filter("m is not null").select("merchant_id", "m", "us", *columns)
            .mapInArrow(_pack, "merchant_id string, hour long, n long, attempts binary"))


def dealt(packs: DataFrame) -> DataFrame:
    """Packs with their ``tile``: an hour's attempts are in windows of its own tile and of the next."""
    return packs.withColumn("tile", F.explode(F.array("hour", F.col("hour") + 1))).drop("hour")


def _block(tile: Column) -> Column:
    return F.floor(tile / BLOCK)


def solved_all(packs: DataFrame, solve: Callable[[pa.Table, int], dict[str, list]], columns: str) -> DataFrame:
    """``solved`` of every tile of packs that are not dealt: a pack moves once to each block of tiles that it is in."""
    own, after = F.col("hour"), F.col("hour") + 1
    to = lambda *of: F.struct(_block(of[0]).alias("block"), F.array(*of).alias("tiles"))
    blocks = F.when(_block(own) == _block(after), F.array(to(own, after))).otherwise(F.array(to(own), to(after)))
    return _solved(packs.select("merchant_id", F.explode(blocks).alias("_b"), "attempts").select("merchant_id", "_b.*", "attempts"), solve, columns)


def solved(packs: DataFrame, solve: Callable[[pa.Table, int], dict[str, list]], columns: str) -> DataFrame:
    """(merchant_id, window_size, end_minute, columns) of every tile of dealt packs. ``solve`` gets the tile's attempts and its first window end."""
    return _solved(packs.select("merchant_id", _block(F.col("tile")).alias("block"), F.array("tile").alias("tiles"), "attempts"), solve, columns)


def _solved(packs: DataFrame, solve: Callable[[pa.Table, int], dict[str, list]], columns: str) -> DataFrame:
    schema = f"merchant_id string, window_size string, end_minute long, {columns}"
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "decimal(38,0)": pa.decimal128(38, 0)}
    fields = [pa.field(*(lambda name, kind: (name, types[kind]))(*x.split(" "))) for x in schema.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        of, done = rows.column("tiles").to_pylist(), []
        for tile in sorted({t for tiles in of for t in tiles}):  # one tile's attempts at a time
            parts = [pa.ipc.open_stream(blob.as_py()).read_all() for blob, tiles in zip(rows.column("attempts"), of) if tile in tiles]
            attempts = pa.concat_tables(parts).unify_dictionaries().combine_chunks()
            out = solve(attempts, tile * TILE + 1)
            out["merchant_id"] = [rows.column("merchant_id")[0].as_py()] * len(out["end_minute"])
            done.append(pa.table([pa.array(out[f.name], f.type) for f in fields], pa.schema(fields)))
        return pa.concat_tables(done)

    # a fixed number of tasks: packs are small beside the work on them, so tasks are not merged by their bytes
    tasks = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packs.repartition(tasks, "merchant_id", "block").groupBy("merchant_id", "block").applyInArrow(run, schema)


def codes(column: pa.ChunkedArray, null: int = -1) -> tuple[np.ndarray, int]:
    """A column's values as numbers from 0 (missing: ``null``), and how many there are."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_dictionary(whole.type):
        whole = whole.dictionary_encode()
    return whole.indices.cast(pa.int32()).fill_null(null).to_numpy(zero_copy_only=False), len(whole.dictionary)


def seen_again(m: np.ndarray, a: np.ndarray, b: np.ndarray, vertices: int) -> np.ndarray:
    """The minute in which each edge is seen next, rows in order of minutes: it counts in a window where it is seen last."""
    edge = a.astype(np.int64) * vertices + b
    order = np.argsort(edge, kind="stable")
    again = np.full(len(m), np.iinfo(np.int64).max)
    same = edge[order][1:] == edge[order][:-1]
    again[order[:-1][same]] = m[order[1:][same]]
    return again


def windows_of(m: np.ndarray, first_end: int, sizes: tuple[str, ...]) -> Iterator[tuple[str, int, int, int]]:
    """(window size, end, first row, end of rows) of the tile's non-empty windows over ordered minutes."""
    for end in range(first_end, first_end + TILE):
        upto = int(np.searchsorted(m, end))
        for size in sizes:
            at = int(np.searchsorted(m, end - HORIZONS[size]))
            if at < upto:
                yield size, end, at, upto


def _entropy(counts: np.ndarray) -> float:
    c = counts[counts > 0].astype(float)
    total = c.sum()
    return max(0.0, float(np.log2(total) - (c * np.log2(c)).sum() / total)) if len(c) else 0.0


def _gini(counts: np.ndarray) -> float:
    held = np.bincount(counts)
    y = np.flatnonzero(held[1:]) + 1
    if not len(y):
        return 0.0
    h = held[y]
    before, items, total = np.cumsum(h) - h, int(h.sum()), float((y * h).sum())
    ranks = float((y * (h * before + h * (h + 1) / 2)).sum())
    return 2.0 * ranks / (items * total) - (items + 1.0) / items


#: what a window's attempts show beside their sums: one column each
CONTENTS = ("items_ins long, items_ip long, foreign long, gaps long, gap_us decimal(38,0), gap_sq decimal(38,0), items_cus long, items_dev long, items_dev_cus long, "
            "total_dev_cus long, top_dev long, top_cus long, top_decline long, top_dev_cus long, top_dev_ins long, top_cus_dev long, top_ip_cus long, "
            "ent_country double, ent_state double, ent_method double, ent_issuer double, ent_decline double, "
            "gini_state double, gini_bin double, gini_dev_cus double, gini_dev_deg double, amt_median double, gap_p05 double, ent_amount double")


def contents_of_tile(sizes: tuple[str, ...]) -> Callable[[pa.Table, int], dict[str, list]]:
    """Item and neighbour counts, gaps, order statistics and amount bins of every non-empty window of a tile."""

    def solve(rows: pa.Table, first_end: int) -> dict[str, list]:
        rows = rows.take(np.lexsort((rows.column("us").to_numpy(), rows.column("m").to_numpy())))
        m, us = rows.column("m").to_numpy(), rows.column("us").to_numpy()
        # a missing category is no item; a missing entity is none when attempts are counted, but a neighbour like any other
        items = {c: codes(rows.column(c)) for c in (*ENTITIES, *CATEGORIES)}
        vertex = {c: (np.where(code < 0, n, code), n + 1) for c, (code, n) in items.items() if c in ENTITIES}
        kinds = {"cd": ("cus", "dev"), "di": ("dev", "ins"), "ci": ("cus", "ip")}
        again = {k: seen_again(m, vertex[a][0], vertex[b][0], vertex[b][1]) for k, (a, b) in kinds.items()}
        home = rows.column("country").combine_chunks().dictionary.index("IN").as_py()  # -1: nowhere
        # amounts in hundredths; a missing one is ranked first and lies in the first bin
        cents = rows.column("cents")
        known = cents.is_valid().to_numpy()
        cents = cents.fill_null(0).to_numpy()
        ordered = np.where(known, cents, np.iinfo(np.int64).min)
        gap = np.diff(us)
        part = lambda x: (x >> 20, x & (1 << 20) - 1)  # noqa: E731  sums and squares in parts that fit 64 bits
        (high, low), sums = part(gap), lambda *x: [np.r_[0, np.cumsum(y)] for y in x]
        squares, paid = sums(high * high, high * low, low * low), sums(*part(cents))
        out: dict[str, list] = {name.split(" ")[0]: [] for name in ("window_size", "end_minute", *CONTENTS.split(", "))}

        for size, end, at, upto in windows_of(m, first_end, sizes):
            put = lambda name, value: out[name].append(value)  # noqa: E731, B023
            put("window_size", size)
            put("end_minute", end)
            n = upto - at
            # code 0 is a missing one
            count = {c: np.bincount(code[at:upto] + 1, minlength=v + 1)[1:] for c, (code, v) in items.items()}
            for c in ENTITIES:
                put(f"items_{c}", int(np.count_nonzero(count[c])))
            for c in ("cus", "dev", "decline"):
                put(f"top_{c}", int(count[c].max(initial=0)))
            put("foreign", int(np.count_nonzero(count["country"])) - int(home >= 0 and count["country"][home] > 0))
            for c in ("country", "state", "method", "issuer", "decline"):
                put(f"ent_{c}", _entropy(count[c]))
            put("gini_state", _gini(count["state"]))
            put("gini_bin", _gini(count["bin"]))
            last = {k: again[k][at:upto] >= end for k in kinds}
            met = lambda k, c: np.bincount(vertex[c][0][at:upto][last[k]], minlength=vertex[c][1])  # noqa: E731, B023
            customers, instruments = met("cd", "dev"), met("di", "dev")
            put("items_dev_cus", int(np.count_nonzero(customers)))
            put("total_dev_cus", int(customers.sum()))
            put("top_dev_cus", int(customers.max()))
            put("gini_dev_cus", _gini(customers))
            put("top_dev_ins", int(instruments.max()))
            put("gini_dev_deg", _gini(customers + instruments))
            put("top_cus_dev", int(met("cd", "cus").max()))
            put("top_ip_cus", int(met("ci", "ip").max()))
            put("gaps", n - 1)
            put("gap_us", Decimal(int(us[upto - 1] - us[at])))
            a, b, c = (int(x[upto - 1] - x[at]) for x in squares)
            put("gap_sq", Decimal((a << 40) + (b << 21) + c))
            rank = int(0.05 * (n - 1))
            put("gap_p05", int(np.partition(gap[at:upto - 1], rank)[rank]) / 1000000 if n > 1 else None)
            put("amt_median", _median(ordered[at:upto]))
            width = max(100.0, ((int(paid[0][upto] - paid[0][at]) << 20) + int(paid[1][upto] - paid[1][at])) / 100 / n * 2.0)
            bins = np.minimum(9.0, np.floor(np.maximum(cents[at:upto], 0) / 100.0 / width * 10))
            put("ent_amount", _entropy(np.bincount(bins.astype(np.int64), minlength=10)))
        return out

    return solve


def _median(ordered: np.ndarray) -> float | None:
    """Median of hundredths, missing ones (the least number) counted first. Where a middle rank falls on them, the least known
    amount that ``order_statistics`` has opened stands there: one of the same bucket, else that of the upper rank."""
    missing, ranks = np.iinfo(np.int64).min, [(len(ordered) - 1) // 2, len(ordered) // 2]
    lo, hi = (int(x) for x in np.partition(ordered, ranks)[ranks])
    if lo == missing:
        same = ordered[(ordered != missing) & (ordered <= 0)]
        lo = int(same.min()) if len(same) else hi
        hi = lo if hi == missing else hi
    return None if lo == missing else (lo + hi) / 2 / 100
