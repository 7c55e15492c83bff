"""Structured Streaming versions of admission, feedback and graph upserts."""
