"""Helpers that shape plans: staged tables and fixpoint loops."""
