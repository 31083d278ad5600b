"""Relational and graph operators over dependency facts."""
