"""Queries of problem 2 (markup residue)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.markup import cleaned_texts, found_markup
from weftgraph.sources.tables import table

_RECORDS = (("markdown", "md_contents", "content_id", "text"), ("html", "html_results", "page_id", "clean_text"), ("document", "documents", "doc_id", "text"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, name, (key, text)).select(F.lit(kind).alias("record_kind"), F.col(key).cast("long").alias("record_id"), F.col(text).alias("text")) for kind, name, key, text in _RECORDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every markup language found in every record."""
    return found_markup(_records(spark, sf_dir))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every record, with counts of the structure kept."""
    return cleaned_texts(_records(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
ORACLES: dict[str, str] = {}
