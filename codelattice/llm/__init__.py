"""Operators for preparing training text: dedup, scoring, mixing, tokenising and storage."""
