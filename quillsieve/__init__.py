"""A PySpark-native engine for cleaning, quality control and profiling of wide tables."""
