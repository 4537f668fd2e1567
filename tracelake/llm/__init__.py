"""Operators for training-data corpora: extraction, tokens, classifiers, deduplication, mixing and packing."""
