"""Replay of event data on Spark."""
