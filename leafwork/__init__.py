"""leafwork: a PySpark-native analytics engine for scanned-document corpora."""
