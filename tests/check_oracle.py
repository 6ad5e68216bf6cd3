"""Runs registered queries against their DuckDB statement: python tests/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(pdf):
    import pandas as pd
    out = pdf[sorted(pdf.columns)].copy()
    for c in out.columns:
        clean = [None if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else v for v in out[c]]
        out[c] = pd.Series([float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in clean], dtype=object, index=out.index)
    rows = sorted(map(tuple, out.values.tolist()), key=lambda r: tuple(map(repr, r)))
    return list(out.columns), [str(t) for t in pdf[sorted(pdf.columns)].dtypes], rows


def compare(got, want) -> str:
    c1, t1, r1 = normal(got)
    c2, t2, r2 = normal(want)
    if c1 != c2:
        return f"columns {set(c1) ^ set(c2)}"
    kinds = [(c, a, b) for c, a, b in zip(c1, t1, t2) if a != b]
    if len(r1) != len(r2):
        return f"rows {len(r1)} vs {len(r2)}"
    if r1 == r2:
        return "ok" + (f" (types {kinds})" if kinds else "")
    bad = {}
    for a, b in zip(r1, r2):
        for c, x, y in zip(c1, a, b):
            if x != y:
                bad.setdefault(c, [0, (x, y)])
                bad[c][0] += 1
    return f"values {dict(list(bad.items())[:6])} types {kinds}"


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from surgelens.session import local_session
    spark, sf_dir = local_session(), f"/root/testdata/sf{sf}"
    con, failed = duck(sf_dir), 0
    qs, sqls = entry.queries(), entry.oracle_sql()
    for name in names or list(qs):
        try:
            t = time.time()
            got = qs[name](spark, sf_dir).toPandas()
            t1 = time.time() - t
            if name not in sqls:
                print(f"{name}: rows only {len(got)} [{t1:.1f}s]", flush=True)
                continue
            t = time.time()
            want = con.execute(sqls[name]).df()
            verdict = compare(got, want)
            failed += not verdict.startswith("ok")
            print(f"{name}: {verdict} rows={len(got)} [{t1:.1f}s, {time.time() - t:.1f}s]", flush=True)
        except Exception as exc:  # noqa: BLE001
            failed += 1
            print(f"{name}: ERROR {str(exc)[:400]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]))
