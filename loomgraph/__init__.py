"""A Spark-native engine for knowledge graphs of software and for text corpora."""
