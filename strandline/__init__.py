"""strandline: a Spark-native engine for semantic memory, retrieval and code analytics."""
