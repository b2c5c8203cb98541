"""tracelode: analytics over engineering text, run state and logs, on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame.  Nothing here keeps state between
calls, and nothing is read to the driver unless a docstring names the bound of its size.
"""

__version__ = "0.1.0"
