"""Operators on unbounded tables: what they allow, and forms of them that Structured Streaming can run."""
