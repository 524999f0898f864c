"""Column-level building blocks, all compiled to native Spark expressions."""
