"""tallyspark: ledger and cash-flow analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames to a DataFrame. Nothing here keeps
a global session; the session always comes from the caller's DataFrames.
"""

__version__ = "0.1.0"
