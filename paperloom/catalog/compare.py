"""Run queries next to their oracles and compare the rows regardless of order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from paperloom.catalog.registry import ORACLES, QUERIES


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, list):
        return tuple(_plain(item) for item in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return Counter(tuple(_plain(row[n]) for n in order) for row in rows)


def oracle_connection(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def compare(spark, sf_dir: str, name: str, connection=None) -> str | None:
    """None when rows and column names agree (or there is no oracle), else what differs."""
    frame = QUERIES[name](spark, sf_dir)
    found = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    if name not in ORACLES:
        return None if found else "no rows"
    cursor = (connection or oracle_connection(sf_dir)).execute(ORACLES[name])
    columns = [entry[0] for entry in cursor.description]
    wanted = _rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} instead of {sorted(columns)}"
    if found == wanted:
        return None
    extra, missing = list((found - wanted).items())[:2], list((wanted - found).items())[:2]
    return f"{sum(found.values())} rows instead of {sum(wanted.values())}; extra {extra}; missing {missing}"
