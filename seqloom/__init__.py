"""seqloom: a PySpark-native engine for sequence-selection data."""
