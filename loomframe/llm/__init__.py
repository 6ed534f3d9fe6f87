"""Operators of a training-data pipeline: dedup, decontamination, tokens, filters, models, archives."""
