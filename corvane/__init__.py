"""corvane: Spark-native mining and analytics operators."""
