"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import decimal
import math

#: Tables for tests.
SMALL = "/root/testdata/sf0.001"


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.8g}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    want = con.sql(sql)
    names, rows = list(want.columns), want.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, rows)
