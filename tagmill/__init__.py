"""tagmill: a Spark-first engine for tag search and corpus processing."""
