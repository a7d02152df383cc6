"""The graphs that queries run on, as DataFrames and as the SQL that builds the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.relational import ForeignKey, Table, entities, observations, relations
from weftgraph.sources.tables import table

#: key column, text and integer cells, foreign keys of the relational tables
CATALOG = {
    "region": ("r_regionkey", ("r_name",), ()),
    "nation": ("n_nationkey", ("n_name",), (("n_regionkey", "region"),)),
    "customer": ("c_custkey", ("c_name", "c_mktsegment"), (("c_nationkey", "nation"),)),
    "supplier": ("s_suppkey", ("s_name",), (("s_nationkey", "nation"),)),
    "part": ("p_partkey", ("p_name", "p_brand", "p_type", "p_size"), ()),
    "orders": ("o_orderkey", ("o_orderstatus", "o_orderpriority"), (("o_custkey", "customer"),)),
}


def catalog_tables(spark: SparkSession, sf_dir: str) -> list[Table]:
    out = []
    for name, (key, cells, foreign) in CATALOG.items():
        rows = table(spark, sf_dir, name, (key, *cells, *[c for c, _ in foreign]))
        out.append(Table(name, rows, (key,), tuple(ForeignKey((c,), p) for c, p in foreign)))
    return out


def struct_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, observations and relations of the relational tables."""
    tables = catalog_tables(spark, sf_dir)
    return entities(tables), observations(tables), relations(tables)


STRUCT_ENTITIES = "\nUNION ALL ".join(f"SELECT DISTINCT '{n}#' || {k} AS name, '{n}' AS entity_type, 'table:{n}/row:' || {k} AS locator FROM {n} WHERE {k} IS NOT NULL" for n, (k, _, _) in CATALOG.items())
STRUCT_OBSERVATIONS = "\nUNION ALL ".join(f"SELECT '{n}#' || {k} AS name, {i} AS ord, '{c}: ' || {c} AS text FROM {n} WHERE {c} IS NOT NULL" for n, (k, cells, _) in CATALOG.items() for i, c in enumerate(cells))
STRUCT_RELATIONS = "\nUNION ALL ".join(
    f"SELECT '{n}#' || x.{k} AS src, '{p}#' || x.{c} AS dst, ['{c}'] AS relation_type FROM {n} x WHERE EXISTS (SELECT 1 FROM {p} y WHERE y.{CATALOG[p][0]} = x.{c})" for n, (k, _, foreign) in CATALOG.items() for c, p in foreign
)
STRUCT = f"WITH ents AS ({STRUCT_ENTITIES}), obs AS ({STRUCT_OBSERVATIONS}), rels AS ({STRUCT_RELATIONS})\n"


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations that trade: one raw edge per order line, from the customer's nation to the supplier's.

    It has what graph operators must cope with: self-loops, parallel and two-way edges, mixed spellings of types, edges
    of the catch-all beside typed ones, and ends without an entity (later lines misspell the nations divisible by 12).
    """
    lines = table(spark, sf_dir, "lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))
    who = table(spark, sf_dir, "orders", ("o_orderkey", "o_custkey")).join(table(spark, sf_dir, "customer", ("c_custkey", "c_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(who, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "supplier", ("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    types = F.when(flag == "A", F.array(F.lit("supplies"))).when((flag == "R") & (status == "F"), F.array(F.lit(" Returns_To"), F.lit("supplies"))).when(flag == "R", F.array(F.lit("supplies"), F.lit("returns_to"))).otherwise(F.array(F.lit("related_to")))
    named = lambda c: F.concat(F.when((F.col(c) % 12 == 0) & (F.col("l_linenumber") > 3), "NATION-").otherwise("NATION_"), F.col(c))
    edges = joined.select(named("c_nationkey").alias("src"), named("s_nationkey").alias("dst"), types.alias("relation_type"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 4, "other").otherwise(F.concat(F.lit("region_"), F.col("n_regionkey"))).alias("entity_type"), F.col("n_nationkey").alias("ord"))
    return nations, edges


TRADE = """WITH ents AS (SELECT n_name AS name, CASE WHEN n_regionkey = 4 THEN 'other' ELSE 'region_' || n_regionkey END AS entity_type, n_nationkey AS ord FROM nation),
rels AS (SELECT CASE WHEN c_nationkey % 12 = 0 AND l_linenumber > 3 THEN 'NATION-' ELSE 'NATION_' END || c_nationkey AS src, CASE WHEN s_nationkey % 12 = 0 AND l_linenumber > 3 THEN 'NATION-' ELSE 'NATION_' END || s_nationkey AS dst,
  CASE WHEN l_returnflag = 'A' THEN ['supplies'] WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN [' Returns_To', 'supplies'] WHEN l_returnflag = 'R' THEN ['supplies', 'returns_to'] ELSE ['related_to'] END AS relation_type,
  l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
folded AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(relation_type, lambda t: lower(trim(t))), lambda t: t <> ''))) AS types FROM rels)
"""


def user_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of users from the event stream: what held from one event of a user to the next, with trust columns."""
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events", ("event_id", "ts", "user_id", "event_type", "value")).withColumn("ts", F.col("ts").cast("timestamp"))
    of_user = W.partitionBy("user_id").orderBy("ts", "event_id")
    grounded = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("boolean")).otherwise(F.col("value") >= 20)
    adapter = F.when(F.col("event_type") == "error", "cv-detector").when(F.col("event_type") == "view", "pdf:tesseract").otherwise("events")
    return events.select(
        F.concat(F.lit("user#"), F.col("user_id")).alias("name"), F.col("event_id").alias("ord"), F.col("event_type").alias("text"), F.col("ts").alias("valid_at"),
        F.when(F.col("event_type") != "signup", F.lead("ts").over(of_user)).alias("invalid_at"), grounded.alias("grounded"), F.round(F.col("value") / 100, 4).alias("grounding_score"),
        F.when(F.col("event_id") % 3 == 0, F.round(F.col("value") / 50, 4)).alias("confidence"), adapter.alias("source_adapter"),
    )


FACTS = """WITH obs AS (SELECT 'user#' || user_id AS name, event_id AS ord, event_type AS text, ts AS valid_at,
  CASE WHEN event_type <> 'signup' THEN lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS invalid_at,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value >= 20 END AS grounded, round(value / 100, 4) AS grounding_score,
  CASE WHEN event_id % 3 = 0 THEN round(value / 50, 4) END AS confidence,
  CASE event_type WHEN 'error' THEN 'cv-detector' WHEN 'view' THEN 'pdf:tesseract' ELSE 'events' END AS source_adapter FROM events)
"""
