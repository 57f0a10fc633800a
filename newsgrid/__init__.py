"""newsgrid: news and incident analytics as plain Spark DataFrame jobs.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
reads the wall clock: jobs that depend on "now" take ``as_of``.
"""

__version__ = "0.1.0"
