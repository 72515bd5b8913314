"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ("", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if hasattr(v, "item"):
        v = v.item()
        return _norm(v)
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, float):
        return ("n", v)
    return ("s", str(v))


def rows_of(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: [(k, f"{v:.4f}" if k == "n" else v) for k, v in r])


def same(a: pd.DataFrame, b: pd.DataFrame) -> str:
    """Empty string when equal, else what differs."""
    ca, ra = rows_of(a)
    cb, rb = rows_of(b)
    if ca != cb:
        return f"columns {ca} != {cb}"
    if len(ra) != len(rb):
        return f"rows {len(ra)} != {len(rb)}"
    inexact = 0
    for x, y in zip(ra, rb):
        for c, (ka, va), (kb, vb) in zip(ca, x, y):
            if ka != kb:
                return f"{c}: {va!r} ({ka}) != {vb!r} ({kb})\n  {x}\n  {y}"
            if va != vb:
                if ka == "n" and abs(va - vb) <= 1e-7 * max(1, abs(va), abs(vb)):
                    inexact += 1
                    continue
                return f"{c}: {va!r} != {vb!r}\n  {x}\n  {y}"
    return f"INEXACT {inexact} cells" if inexact else ""


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in df.columns}


def check(spark, con, sf_dir: str, name: str, queries, oracles) -> str:
    got = queries[name](spark, sf_dir).toPandas()
    if name not in oracles:
        return f"rows-only {len(got)}"
    want = con.execute(oracles[name]).df()
    diff = same(got, want)
    if diff:
        return "DIFF " + diff
    ka, kb = kinds(got), kinds(want)
    odd = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]}
    return f"ok {len(got)} rows" + (f" KINDS {odd}" if odd else "")


def main() -> None:
    import __spark_entry__ as e
    from tidemark.session import local_session

    sf_dir = sys.argv[1]
    want = sys.argv[2:]
    qs, os_ = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    spark = local_session(8)
    bad = 0
    for name in qs:
        if want and not any(name == w or name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            res = check(spark, con, sf_dir, name, qs, os_)
        except Exception as ex:  # noqa: BLE001 - report every query
            res = "ERROR " + str(ex)[:1500]
        bad += res.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - t:6.2f}s {res}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
