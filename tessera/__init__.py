"""A PySpark-native engine for a compact select-project-join-aggregate dialect."""
