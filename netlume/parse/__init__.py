"""Protocol parsers: bytes to nullable fields."""
