"""tidefold: log-structured key-value analytics and training-data operators on PySpark."""
