"""Column functions: URLs, text, markdown, addresses, JSON, tokens."""
