"""A Spark-native engine for sequence design and corpus analytics."""
