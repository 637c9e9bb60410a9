"""Media-stream analytics and training-data operators on Spark."""
