"""Road-lane analytics on PySpark."""
