"""Operators of a training-data pipeline: sharding, quality, deduplication, tokens, chat, mixing, privacy."""
