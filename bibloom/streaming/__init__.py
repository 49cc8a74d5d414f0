"""Bibloom: streaming."""
