"""Analytics on annotated conversations as Spark DataFrame operators."""
