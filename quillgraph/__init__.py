"""Citation-graph analytics and large-scale text operators as PySpark DataFrame jobs."""
