"""Market-microstructure analytics as PySpark DataFrame and streaming operators."""
