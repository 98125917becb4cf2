"""Protocol Buffer messages as Spark SQL columns."""
