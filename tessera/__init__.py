"""Retrieval-corpus jobs on Spark: plain DataFrame-in, DataFrame-out functions."""
