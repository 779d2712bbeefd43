"""Retail price analytics as lazily planned Spark DataFrames."""
