"""Operators for preparing training data: tokens, mixing, archives, duplicates, labels, search and private data."""
