"""Column functions: box algebra, frames, names, text, vectors."""
