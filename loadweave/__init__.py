"""Electricity-load analytics on Spark DataFrames.

Every public function takes DataFrames and returns DataFrames; nothing larger
than a model coefficient table or a handful of scalars reaches the driver.
"""

__version__ = "0.1.0"
