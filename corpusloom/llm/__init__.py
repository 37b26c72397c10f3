"""Operators of a training-data pipeline (toxicity, language, near-duplicates, mixing, packing, ...)."""
