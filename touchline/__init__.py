"""Touchline: analytics over match-tracking data, written as Spark plans."""
