"""Analytics over semi-structured documents and records, written for PySpark."""
