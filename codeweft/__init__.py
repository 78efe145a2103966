"""codeweft: a Spark-native code knowledge graph and hybrid retrieval engine."""
