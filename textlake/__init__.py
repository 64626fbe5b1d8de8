"""textlake: a PySpark-native engine for text corpora."""
