"""tidemark: a PySpark-native analytics and retrieval engine for versioned documents and event histories."""
