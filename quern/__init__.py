"""A recursive-query (Datalog) engine on Spark DataFrames."""

__version__ = "0.1.0"
