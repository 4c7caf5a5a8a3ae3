"""The catalogue of queries with their SQL, and the session that strings them together."""
