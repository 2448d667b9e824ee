"""A query's rows against those of its oracle SQL."""

import math
from decimal import Decimal

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Sums of floats differ in their last digits by the order of adding; beside large values that is no small amount.
RELATIVE = 1e-12


def rows_of(table: pa.Table) -> list[tuple]:
    """The rows with columns by name: None for null and NaN, floats for all non-integers, strings for the rest."""

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float | Decimal):
            return float(v) + 0.0
        return int(v) if isinstance(v, int) else str(v)

    columns = [[value(v) for v in table[name].to_pylist()] for name in sorted(table.column_names)]
    # rows are matched by order: exact values first, and of floats six digits, so that the last one doesn't matter
    key = lambda row: ([str(v) for v in row if not isinstance(v, float)], [f"{v:.6g}" for v in row if isinstance(v, float)])
    return sorted(zip(*columns, strict=True), key=key)


def equal(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, int | float) or isinstance(b, float) and isinstance(a, int):
        return math.isclose(a, b, rel_tol=RELATIVE, abs_tol=5e-7)
    return a == b


def oracle(sql: str, folder: str) -> pa.Table:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con.execute(sql).to_arrow_table()


def same(df, sql: str, folder: str) -> None:
    ours, theirs = df.toArrow(), oracle(sql, folder)
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    a, b = rows_of(ours), rows_of(theirs)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(equal, x, y))]
    assert not wrong, wrong[:3]
