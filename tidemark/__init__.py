"""tidemark: a PySpark-native engine for event-shaped session data."""
