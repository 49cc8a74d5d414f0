"""Bibloom: functions."""
