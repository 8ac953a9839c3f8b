"""meterlens: usage analytics over the operational logs of data platforms, on Spark.

Every operator is a function from DataFrames to a DataFrame.  Nothing is
collected, cached or looked up outside the plan; the caller decides when to run.
"""

__version__ = "0.1.0"
