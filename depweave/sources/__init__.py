"""Where facts come from and where snapshots go."""
