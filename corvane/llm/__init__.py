"""Operators of a training-data pipeline: scoring, media, tokens, deduplication, extraction, filters, packing.

Nothing outside this folder imports it.
"""
