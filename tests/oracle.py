"""Compare a query with its SQL on the same tables, order-insensitively."""

import math
from pathlib import Path

import duckdb

import __spark_entry__ as entry


def rows(frame):
    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6)
        if hasattr(x, "item"):
            return plain(x.item())
        return x

    return sorted((tuple(plain(x) for x in r) for r in frame), key=lambda r: tuple((x is None, str(x)) for x in r))


def check(spark, name, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).iterdir():
        src = p / "*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    got = entry.queries()[name](spark, str(sf))
    cols = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols, (names, cols)
    order = [names.index(c) for c in cols]
    expected = [tuple(r[i] for i in order) for r in want.fetchall()]
    actual = [tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()]
    a, b = rows(actual), rows(expected)
    assert len(a) == len(b), f"{name}: {len(a)} rows, expected {len(b)}"
    for x, y in zip(a, b):
        assert x == y, f"{name}: {x} != {y}"
    return len(a)
