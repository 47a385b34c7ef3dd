"""A PySpark-native engine for static-analysis findings."""
