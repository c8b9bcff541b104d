"""Text conformance analytics on PySpark."""
