"""hireframe: Spark-native analytics for job postings.

Every operator is a plain function ``DataFrame -> DataFrame`` (``df.transform``
friendly) built from Spark SQL expressions, joins, windows and aggregates.
No function creates a session; callers pass DataFrames in.
"""

__version__ = "0.1.0"
