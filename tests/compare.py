"""Order-free comparison of a Spark result with DuckDB's."""

import pandas as pd


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if not isinstance(v, list) and pd.isna(v):
        return "-"
    if isinstance(v, list):
        return str([cell(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


def same(spark_df, duck_df):
    a, b = rows(spark_df.toPandas()), rows(duck_df)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1], strict=True):
        assert x == y
