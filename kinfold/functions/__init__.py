"""Column functions: text, sets, vectors, JSON, URLs, CSV."""
