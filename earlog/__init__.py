"""Listening-history analytics on PySpark DataFrames."""
