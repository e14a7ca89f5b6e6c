"""Column functions over log payloads, keys and records."""
