"""Lodewright: knowledge-graph evaluation and data preparation on PySpark DataFrames."""
