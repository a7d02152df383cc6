"""SQLite files as relational tables: keys and foreign keys from the file's own catalogue, rows read in ranges.

The catalogue (tables, columns, keys) is read on the driver and is as small as the schema; rows are read by the tasks,
each a range of row numbers, so the file must lie in a folder that all executors see. Cells come as text (``cell_text``
of relational.py types them); blobs are left out. Tables without row numbers are read in one range by their key.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from weftgraph.functions.shipping import by_value
from weftgraph.sources.relational import ForeignKey, Table


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def catalogue(path: str) -> dict[str, dict]:
    """Per table its columns (name, type), key columns and foreign keys (columns, parent, parent columns)."""
    out = {}
    with _open(path) as con:
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
        for name in names:
            info = con.execute(f"PRAGMA table_info({_quoted(name)})").fetchall()
            key = tuple(r[1] for r in sorted((r for r in info if r[5]), key=lambda r: r[5]))
            links: dict[int, tuple[str, list]] = {}
            for number, seq, parent, child, to, *_ in con.execute(f"PRAGMA foreign_key_list({_quoted(name)})"):
                links.setdefault(number, (parent, []))[1].append((seq, child, to))
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(name)}").fetchone()
                numbered = True
            except sqlite3.OperationalError:  # WITHOUT ROWID
                low, high, numbered = None, None, False
            out[name] = {"columns": [(r[1], r[2]) for r in info], "key": key, "links": [(tuple(c for _, c, _ in sorted(parts)), parent, tuple(t for _, _, t in sorted(parts))) for parent, parts in links.values()], "range": (low, high), "numbered": numbered}
    return out


def table_rows(spark: SparkSession, path: str, name: str, about: dict, step: int = 100_000) -> DataFrame:
    """All rows of a table, read in ranges of ``step`` row numbers; every column as text."""
    columns = [c for c, _ in about["columns"]]
    low, high = about["range"]
    ranges = [(a, a + step) for a in range(low, high + 1, step)] if about["numbered"] and low is not None else [(None, None)]
    picked = ", ".join(f"CASE WHEN typeof({_quoted(c)}) <> 'blob' THEN CAST({_quoted(c)} AS TEXT) END" for c in columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _open(path) as con:
            for batch in batches:
                for a, b in zip(batch["a"], batch["b"]):
                    part = f"SELECT {picked} FROM {_quoted(name)}" + ("" if pd.isna(a) else f" WHERE rowid >= {int(a)} AND rowid < {int(b)}")
                    cursor = con.execute(part)
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=columns, dtype=object)

    todo = spark.createDataFrame(ranges, "a long, b long").repartition(min(len(ranges), 512))
    return todo.mapInPandas(read, ", ".join(f"`{c}` string" for c in columns))


def sqlite_tables(spark: SparkSession, path: str) -> list[Table]:
    """Every user table with its key and those foreign keys that name the parent's whole key."""
    about = catalogue(path)
    out = []
    for name, t in about.items():
        foreign = tuple(ForeignKey(cols, parent) for cols, parent, to in t["links"] if parent in about and tuple(x or k for x, k in zip(to, about[parent]["key"])) == about[parent]["key"] and len(cols) == len(about[parent]["key"]))
        out.append(Table(name, table_rows(spark, path, name, t), t["key"], foreign))
    return out


by_value(__name__)
