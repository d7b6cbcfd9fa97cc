"""Runs queries and their SQL side by side: ``python tests/compare.py SF [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def plain(value):
    if value is None or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(pdf) -> tuple[list[str], list[tuple]]:
    columns = sorted(pdf.columns)
    rows = [tuple(plain(v) for v in r) for r in pdf[columns].itertuples(index=False)]
    return columns, sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def difference(spark_pdf, oracle_pdf) -> str | None:
    a_columns, a = rows_of(spark_pdf)
    b_columns, b = rows_of(oracle_pdf)
    if a_columns != b_columns:
        return f"columns {a_columns} / {b_columns}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference\n    {str(x)[:600]}\n    {str(y)[:600]}"
    kinds_a = {c: spark_pdf[c].dtype.kind for c in a_columns}
    kinds_b = {c: oracle_pdf[c].dtype.kind for c in a_columns}
    if {c: str(spark_pdf[c].dtype) for c in a_columns} != {c: str(oracle_pdf[c].dtype) for c in a_columns}:
        note = {c: (str(spark_pdf[c].dtype), str(oracle_pdf[c].dtype)) for c in a_columns
                if str(spark_pdf[c].dtype) != str(oracle_pdf[c].dtype)}
        # A column of integers with nulls is one of floats in pandas.
        holed = {c for c in a_columns if {kinds_a[c], kinds_b[c]} <= {"i", "f"} and spark_pdf[c].isna().any()}
        if {c: k for c, k in kinds_a.items() if c not in holed} != {c: k for c, k in kinds_b.items() if c not in holed} and len(a):
            return f"types {note}"
    return None


def main() -> int:
    from deckflow.session import local_session

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
        except Exception as e:
            print(f"FAIL  {name}: {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        sql = entry.oracle_sql().get(name)
        start = time.time()
        try:
            said = difference(got, oracle(sql, sf_dir)) if sql else None
        except Exception as e:
            said = f"oracle: {str(e)[:1000]}"
        bad += said is not None
        state = "FAIL" if said else ("ok  " if sql else "rows")
        print(f"{state}  {name}: {len(got)} rows, {took:.1f} s, oracle {time.time() - start:.1f} s {said or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
