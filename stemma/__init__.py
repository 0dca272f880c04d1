"""Lineage-graph and document analytics on PySpark DataFrames."""
