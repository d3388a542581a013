"""lexloom: a PySpark-native text-analytics engine for language-model data preparation."""

__version__ = "0.1.0"
