"""Side-by-side check of every registered query against its DuckDB twin (the same
contract the driver uses: row count, column names, order-free values)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from strata.plans.registry import oracle_sql, queries  # noqa: E402
from strata.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, sf_dir: str, names=None, verbose=True):
    con = duck(sf_dir)
    qs, sql = queries(), oracle_sql()
    results = {}
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        st = time.time() - t0
        if name not in sql:
            results[name] = f"rows-only {len(s_rows)}"
            if verbose:
                print(f"{name:28s} rows-only n={len(s_rows)} {st:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sql[name])
            d_cols = [d[0] for d in cur.description]
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCK ERROR {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        sc, sr = rows_of(s_cols, s_rows)
        dc, dr = rows_of(d_cols, d_rows)
        if sc != dc:
            results[name] = f"COLUMNS {sc} vs {dc}"
        elif len(sr) != len(dr):
            results[name] = f"ROWCOUNT {len(sr)} vs {len(dr)}"
        elif sr != dr:
            bad = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
            results[name] = f"VALUES differ e.g. {bad}"
        else:
            results[name] = "ok"
        if verbose:
            print(f"{name:28s} {results[name][:400]} n={len(sr)} {st:.1f}s", flush=True)
    return results


if __name__ == "__main__":
    from strata.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = set(sys.argv[2:]) or None
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v != "ok" and not v.startswith("rows-only")}
    print(f"TOTAL {len(res)} ok={sum(v == 'ok' for v in res.values())} rows-only={sum(v.startswith('rows-only') for v in res.values())} bad={len(bad)}")
