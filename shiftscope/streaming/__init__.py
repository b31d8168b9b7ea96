"""Structured Streaming forms of the event, sensor and daily-metric jobs."""
