"""tidemark: PySpark-native retrieval and analytics operators."""
