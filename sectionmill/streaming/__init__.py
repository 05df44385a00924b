"""Streaming jobs over manifest and progress events."""
