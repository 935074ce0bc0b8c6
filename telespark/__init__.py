"""telespark: Spark-native telemetry analytics.

Every public operator takes DataFrames and returns a DataFrame. The heavy work is
expressed with built-in Spark SQL expressions, joins, aggregates and windows, so
Catalyst plans it and the same code runs on a laptop or a cluster.
"""

__version__ = "0.1.0"
