"""PySpark-native analytics over media and entity catalogues."""
