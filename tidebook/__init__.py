"""PySpark-native order-flow analytics."""
