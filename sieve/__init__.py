"""A PySpark-native engine for labelled message and document corpora."""
