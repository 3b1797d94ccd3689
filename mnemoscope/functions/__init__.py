"""Column expressions: text, numbers, JSON, hashing, token counts and redaction."""
