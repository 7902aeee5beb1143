"""A PySpark-native engine for leakage-controlled tabular datasets and their evaluation."""
