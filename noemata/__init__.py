"""Spark-native engine for grounded facts: extraction, consolidation, retrieval and reasoning over DataFrames."""
