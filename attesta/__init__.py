"""Attesta: evidence and consensus analytics on Spark DataFrames."""
