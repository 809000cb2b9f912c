"""Operators for preparing training data: identification, scoring, fingerprints, mixing, encoding and deduplication."""
