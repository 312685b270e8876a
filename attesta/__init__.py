"""PySpark-native evidence, entity-resolution and qualification engine."""
