"""Operators that prepare text, pages and dialogues for training."""
