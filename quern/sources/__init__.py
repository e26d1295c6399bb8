"""Delimited files in and out, and DataFrames as relations."""
