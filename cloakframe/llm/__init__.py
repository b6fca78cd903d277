"""Operators of a training-data pipeline: sharding, search, language identification, mixing, deduplication, quality, tokens, chat and pages."""
