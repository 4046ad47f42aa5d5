"""Multi-resolution graph analytics and corpus operators on PySpark."""
