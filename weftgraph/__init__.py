"""weftgraph: knowledge-graph building, resolving, scoring and exporting on Spark DataFrames."""
