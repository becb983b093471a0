"""Iterative and streaming jobs."""
