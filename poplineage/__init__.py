"""Lineage and population analytics over event logs, on Spark DataFrames."""
