"""loomline: a Spark-native engine for explainable text metrics and corpus statistics."""

__version__ = "0.1.0"
