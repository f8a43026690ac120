"""Side-by-side check of a query and its SQL, the way results are judged: same rows, same
column names, same values in any order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"f{value!r}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(canon(r[k]) for k in order) for r in rows)


def spark_rows(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return table([c[0] for c in cur.description], cur.fetchall())


def differences(spark_side, duck_side) -> str:
    """Empty when equal."""
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} / {duck_side[0]}"
    if len(spark_side[1]) != len(duck_side[1]):
        return f"rows {len(spark_side[1])} / {len(duck_side[1])}"
    bad = [(a, b) for a, b in zip(spark_side[1], duck_side[1]) if a != b]
    return f"{len(bad)} of {len(spark_side[1])} rows differ, first {bad[0]}" if bad else ""
