"""Operators for preparing training text: deduplication, scoring, scanning, counting and mixing."""
