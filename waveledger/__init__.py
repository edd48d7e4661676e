"""waveledger: analytics over fleets of sensor recordings, written for Spark.

Every operator is a function from DataFrame to DataFrame.  See README.md for the
table layouts and for the rules the operators follow at scale.
"""

__version__ = "0.1.0"
