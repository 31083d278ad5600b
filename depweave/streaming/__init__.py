"""Streams of facts."""
