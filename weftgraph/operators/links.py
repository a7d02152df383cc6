"""Reference graphs: links between documents, following them, and symbols of source code."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.references import is_external, link_slug, links
from weftgraph.functions.shipping import by_value
from weftgraph.session import cut


def reference_graph(documents: DataFrame, path: str, text: str) -> DataFrame:
    """(src, dst, relation_type, resolved): ``links_to`` documents of the corpus by folded base name, else ``cites``.

    Of documents with the same base name the one with the least path is meant; each target counts once per document.
    """
    named = documents.where(F.col(path).isNotNull()).select(F.col(path).alias("src"), F.explode(links(F.col(text))).alias("target")).where("target <> ''")
    known = documents.where(F.col(path).isNotNull()).groupBy(link_slug(F.col(path)).alias("slug")).agg(F.min(path).alias("found"))
    keyed = named.withColumn("slug", F.when(~is_external(F.col("target")), link_slug(F.col("target"))))
    joined = keyed.join(known, "slug", "left")
    hit = F.col("found").isNotNull()
    return joined.select("src", F.coalesce("found", "target").alias("dst"), F.when(hit, "links_to").otherwise("cites").alias("relation_type"), hit.alias("resolved")).where("src <> dst").distinct()


def followed(edges: DataFrame, start: DataFrame, max_depth: int = 3) -> DataFrame:
    """(name, depth): what resolved links reach from the start within so many steps (0: without limit), each at its least depth.

    The frontier and what has been seen are written after every step, so a long walk has a short lineage.
    """
    seen = cut(start.select("name", F.lit(0).alias("depth")).distinct())
    depth = 0
    while not max_depth or depth < max_depth:
        depth += 1
        frontier = seen.where(F.col("depth") == depth - 1)
        reached = edges.join(frontier, edges["src"] == frontier["name"]).select(F.col("dst").alias("name")).distinct()
        fresh = cut(reached.join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen = cut(seen.unionByName(fresh))
    return seen


def disallowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs (host, path) that no rule (host, prefix) forbids: every prefix of a path is looked up, no pairing of all."""
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda n: F.substr("path", F.lit(1), n))
    hit = urls.select("host", "path", F.explode(prefixes).alias("prefix")).join(rules.where("prefix <> ''").select("host", "prefix").distinct(), ["host", "prefix"], "left_semi").select("host", "path").distinct()
    return urls.join(hit, ["host", "path"], "left_anti")


def rebuilt_content(pieces: DataFrame, key: str) -> DataFrame:
    """(key, content) of overlapping pieces (key, idx, start, content): what a piece repeats is dropped."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "start", "content")))
    glue = lambda whole, p: F.concat(whole, F.substr(p["content"], F.greatest(F.length(whole) - p["start"], F.lit(0)).cast("int") + 1))
    return pieces.groupBy(key).agg(F.aggregate(ordered, F.lit(""), glue).alias("content"))


def _symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, code in zip(batch["path"], batch["content"]):
            try:
                tree = ast.parse(code or "")
            except (SyntaxError, ValueError, RecursionError):
                continue
            for node in ast.walk(tree):
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    kind = "class" if isinstance(node, ast.ClassDef) else "function"
                    rows.append((path, path, "contains", node.name, kind))
                    rows += [(path, node.name, "extends", b.id, "class") for b in getattr(node, "bases", []) if isinstance(b, ast.Name)]
                    calls = {c.func.id for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)}
                    rows += [(path, node.name, "calls", c, "function") for c in sorted(calls)]
                elif isinstance(node, ast.Import):
                    rows += [(path, path, "imports", a.name, "module") for a in node.names]
                elif isinstance(node, ast.ImportFrom) and node.module:
                    rows.append((path, path, "imports", node.module, "module"))
        yield pd.DataFrame(rows, columns=["path", "src", "relation_type", "dst", "dst_kind"])


def code_symbols(files: DataFrame) -> DataFrame:
    """(path, src, relation_type, dst, dst_kind) of Python sources: definitions, calls, bases, imports; broken files give none."""
    return files.select("path", "content").mapInPandas(_symbols, "path string, src string, relation_type string, dst string, dst_kind string").distinct()


by_value(__name__)
