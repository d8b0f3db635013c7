"""Metascience analytics on Spark DataFrames."""
