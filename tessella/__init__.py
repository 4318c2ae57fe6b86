"""tessella: a PySpark-native engine for preparing, auditing and scoring text and tool-calling corpora."""
