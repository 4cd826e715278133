"""Scoring prompts as they arrive."""
