"""tessera: a Spark-native engine for entity-resolution analytics."""
