"""Bibloom: sources."""
