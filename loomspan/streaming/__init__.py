"""Question feeds as streams."""
