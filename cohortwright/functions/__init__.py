"""Column expressions: identifiers, recoding, stable hashing, safe arithmetic."""
