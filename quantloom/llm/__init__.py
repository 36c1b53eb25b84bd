"""Corpus operators for training-data pipelines: dedup, tokens, language, extraction."""
