"""Operators for preparing training corpora: packing, scans, dedup, scoring, encoding."""
