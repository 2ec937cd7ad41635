"""Queries held against their SQL, row by row."""

import math
import os
from pathlib import Path

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def differences(spark, query, sql):
    """Rows that stand on one side alone; columns have to be the same."""
    import duckdb

    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    rows, said = query(spark, SF_DIR), con.sql(sql)
    names = sorted(rows.columns)
    assert sorted(said.columns) == names
    ours = sorted((plain(tuple(r)) for r in rows.select(*names).collect()), key=repr)
    theirs = sorted((plain(r) for r in said.project(", ".join(f'"{n}"' for n in names)).fetchall()), key=repr)
    assert len(ours) == len(theirs) > 0
    return [(a, b) for a, b in zip(ours, theirs) if a != b]
