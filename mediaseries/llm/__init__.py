"""Operators for preparing training data: deduplication, decontamination, filtering, counting, mixing."""
