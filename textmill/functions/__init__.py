"""Column functions: text in, text out."""
