"""Structured Streaming forms of the append steps (beyond the surveyed operators)."""
