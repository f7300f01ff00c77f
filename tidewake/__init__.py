"""Vessel-track and catch-effort analytics expressed as Spark plans."""
