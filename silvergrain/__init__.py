"""silvergrain: a Spark-native engine for retrieval and corpus analytics over file collections."""
