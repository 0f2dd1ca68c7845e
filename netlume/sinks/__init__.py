"""Rendering of alerts and flow records, and where they go."""
