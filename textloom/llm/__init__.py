"""Training-data operators: deduplication, decontamination, extraction, tagging and encoding over Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
