"""lintel: a Spark-native engine for auditing web markup and preparing text corpora at scale."""
