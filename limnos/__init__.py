"""limnos: Spark-native monitoring analytics (batch + streaming).

Every operator takes DataFrames and returns a DataFrame built from native
Spark expressions so Catalyst plans the whole job.
"""

__version__ = "0.1.0"
