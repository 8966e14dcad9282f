"""lodestar: vector search and corpus preparation as Spark DataFrame operators."""
