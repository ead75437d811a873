"""Tessella: corpus analytics, retrieval and graph operators on Spark DataFrames."""
