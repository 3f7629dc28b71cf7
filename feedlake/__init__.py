"""A PySpark-native analytics engine for social-post feeds."""
