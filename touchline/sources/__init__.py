"""Readers of the tables and of report files."""
