"""Operators of a training-data pipeline: scoring, de-duplication, mixing, tokenising, scans, classification, archives."""
