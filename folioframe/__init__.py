"""Folioframe: PySpark-native analytics over document files."""
