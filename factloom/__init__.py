"""factloom: source-code facts and corpus tables as Spark DataFrames, questions as queries."""

__version__ = "0.1.0"
