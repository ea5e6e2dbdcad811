"""Column functions: text, names and numbers, Markdown, page layout, vectors, models."""
