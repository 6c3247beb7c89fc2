"""Operators of a training-data pipeline: tokens, mixing, filters, near copies, search and language models."""
