"""Spark-native static inspection of macro containers, and large-scale corpus operators."""
