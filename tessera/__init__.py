"""Tessera: identity resolution, activity inference and analytical queries on Spark DataFrames."""
