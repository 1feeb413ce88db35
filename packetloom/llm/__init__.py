"""Operators for building training data: search, extraction, deduplication, quality, tokens, mixing, packing, chat."""
