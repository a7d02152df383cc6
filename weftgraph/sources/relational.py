"""Relational tables to a graph: rows are entities, cells observations, foreign keys edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import key_predicate


@dataclass(frozen=True)
class ForeignKey:
    """Columns of a table that name a row of ``parent``."""

    columns: tuple[str, ...]
    parent: str

    @property
    def predicate(self) -> str:
        return key_predicate(self.columns[0], self.parent) if len(self.columns) == 1 else self.parent.lower()


@dataclass(frozen=True)
class Table:
    """A table with its key (none: a row is named by a hash of all its cells) and foreign keys."""

    name: str
    rows: DataFrame
    key: tuple[str, ...] = ()
    foreign: tuple[ForeignKey, ...] = ()

    def row_name(self):
        if not self.key:
            return F.concat(F.lit(self.name + "#"), F.sha1(F.to_json(F.struct(*sorted(self.rows.columns)))))
        return _named(self.name, self.key)


def capped(table: Table, cap: int = 5000) -> Table:
    """At most ``cap`` rows by key: the row limit of an ingestion, deterministic and off unless asked for."""
    order = [F.col(c) for c in (table.key or tuple(sorted(table.rows.columns)))]
    return Table(table.name, table.rows.orderBy(*order).limit(cap), table.key, table.foreign)


def entities(tables: list[Table]) -> DataFrame:
    """(name, entity_type, locator), once per row name."""
    parts = [t.rows.select(t.row_name().alias("name"), F.lit(t.name).alias("entity_type")) for t in tables]
    named = reduce(DataFrame.unionByName, parts).where(F.col("name").isNotNull()).distinct()
    pk = F.regexp_replace("name", r"^[^#]*#", "")
    return named.withColumn("locator", F.concat(F.lit("table:"), F.col("entity_type"), F.lit("/row:"), pk))


def observations(tables: list[Table]) -> DataFrame:
    """(name, ord, text) of the non-null cells that are neither key nor foreign key: ``column: value``."""
    parts = []
    for t in tables:
        linked = {c for f in t.foreign for c in f.columns} | set(t.key)
        cells = [c for c in t.rows.columns if c not in linked]
        if cells:
            said = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("ord"), F.concat(F.lit(f"{c}: "), F.col(c).cast("string")).alias("text"))) for i, c in enumerate(cells)])
            parts.append(t.rows.select(t.row_name().alias("name"), F.explode(F.filter(said, lambda x: x.isNotNull())).alias("o")).select("name", "o.ord", "o.text"))
    return reduce(DataFrame.unionByName, parts)


def relations(tables: list[Table]) -> DataFrame:
    """(src, dst, relation_type): an edge for every foreign key whose parts are set and whose parent row exists."""
    by_name = {t.name: t for t in tables}
    parts = []
    for t in tables:
        for f in t.foreign:
            parent = by_name[f.parent]
            there = parent.rows.select(parent.row_name().alias("dst")).distinct()
            child = t.rows.select(t.row_name().alias("src"), _named(parent.name, f.columns).alias("dst"))
            parts.append(child.join(there, "dst").select("src", "dst", F.array(F.lit(f.predicate)).alias("relation_type")))
    return reduce(DataFrame.unionByName, parts)


def _named(table: str, columns: tuple[str, ...]):
    """``table#key``; any null part names no row."""
    parts = [F.col(c).cast("string") for c in columns]
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(whole, F.concat(F.lit(table + "#"), F.concat_ws("|", *parts)))


def cell_text(value, kind: str):
    """A cell of a typed column as text: booleans by word, epoch numbers and bare dates as UTC instants."""
    number = value.try_cast("double")
    if kind.lower() in ("bool", "boolean"):
        return F.when(value.isin("0", "false"), "false").when(value.isin("1", "true"), "true").otherwise(value)
    if kind.lower() in ("date", "datetime", "timestamp"):
        micros = F.when(F.abs(number) > 1e12, number * 1000).otherwise(number * 1_000_000).cast("long")
        stamp = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return F.when(number.isNotNull(), stamp).when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(value, F.lit("T00:00:00Z"))).otherwise(value)
    return value
