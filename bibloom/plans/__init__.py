"""Bibloom: plans."""
