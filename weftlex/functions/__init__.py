"""Column functions: text, hashing and vectors."""
