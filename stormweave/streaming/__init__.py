"""Structured Streaming jobs: report log, dead letters, replay and the continuous pipeline."""
