"""Knowledge-graph and text analytics as Spark DataFrame operations."""
