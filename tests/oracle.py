"""Compare one Spark result with DuckDB on the same Parquet files."""

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    def show(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "~"
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else repr(v)  # a NULL turns a whole pandas column to float
        return f"{type(v).__name__[:3]}:{v}" if isinstance(v, bool) else str(v)

    out = pd.DataFrame({c: [show(v) for v in frame[c].tolist()] for c in sorted(frame.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    kinds = {
        c: (got[c].dtype.kind, want[c].dtype.kind)
        for c in got.columns
        if got[c].dtype.kind != want[c].dtype.kind and not got[c].isna().any()
    }
    if kinds:
        return f"kinds {kinds}"
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return ""
    bad = (a != b).any(axis=1)
    return f"{int(bad.sum())} rows differ:\n{a[bad].head(4).to_string()}\n--\n{b[bad].head(4).to_string()}"
