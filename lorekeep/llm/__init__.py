"""Operators for building training data from the memory: deduplication, linking, mixing, labelling."""
