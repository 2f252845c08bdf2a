"""A PySpark-native analytics engine for multilingual statute and document corpora."""
