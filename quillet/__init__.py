"""Quillet: code-corpus analytics and corpus preparation on Spark DataFrames."""
