"""Structured Streaming forms of operators; the analysis they extend is batch only."""
