"""Bibloom: operators."""
