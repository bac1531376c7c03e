"""Training-data operators: ten Spark jobs over document and vector tables."""
