"""dayspan: interval tables, day matrices and the models built on them, on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
and Spark ML built-ins. Library code never creates a session, never sets a
master and never collects data to the driver.
"""

__version__ = "0.1.0"
