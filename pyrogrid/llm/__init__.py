"""Operators for preparing training text: fingerprints, dedup, tokens, packing, quality, language, privacy."""
