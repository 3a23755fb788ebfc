"""Column functions: text, regular-expression spans, vectors."""
