"""Structured Streaming jobs over request, evidence and stage logs."""
