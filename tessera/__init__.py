"""Tessera: keyed relations and entity queries on Spark DataFrames."""
