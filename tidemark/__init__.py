"""Tidemark: payment-decision analytics on Spark DataFrames."""
