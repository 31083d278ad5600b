"""Column functions: identities, names, texts."""
