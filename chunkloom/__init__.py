"""chunkloom: chunked, typed, n-dimensional arrays as Spark DataFrames."""

__version__ = "0.1.0"
