"""Column functions: text, numbers, identities and ranks."""
