"""Retail invoicing analytics on Spark DataFrames."""
