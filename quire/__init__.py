"""quire: document analytics as lazy Spark plans.

Every operator takes DataFrames and returns a DataFrame. Nothing is collected inside an operator except values
whose size is bounded by a parameter or an alphabet, and each such place says so.
"""

__version__ = "0.1.0"
