"""corpuskiln: a PySpark-native engine for parallel-text and correction corpora."""
