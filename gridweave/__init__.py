"""gridweave: Spark-native analytics for gridded mobility data."""
