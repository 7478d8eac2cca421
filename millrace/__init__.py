"""millrace: a PySpark-native catalogue and event engine."""
