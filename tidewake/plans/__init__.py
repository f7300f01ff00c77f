"""Whole pipelines as one lazy plan each."""
