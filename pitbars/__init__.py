"""Point-in-time daily bars as PySpark jobs."""
