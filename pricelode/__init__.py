"""Price-comparison and corpus jobs as Spark DataFrame operations."""
