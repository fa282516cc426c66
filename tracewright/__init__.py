"""PySpark-native analytics over trajectory, document, page and conversation datasets."""
