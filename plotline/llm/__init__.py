"""Corpus-preparation operators for training data (deduplication, mixing, privacy, packing, ...)."""
